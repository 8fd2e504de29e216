"""Registered queries of this package: one per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import bpe, collocations, jaccard_join, language, mixing, pii, quality_rules, secret_scan, site_quality, suffix_dedup, topk, url_filter, vector_codes
from hourcast.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.learn(docs, load(spark, sf_dir, "labels")))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(load(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join_documents(load(spark, sf_dir, "documents"), size=5, percent=75)
    return out.select("doc_id", "n_shingles", "component_id")


ORACLES["op3_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM w
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


#: Sites by host and path, then globs that judge what no site rule names.
URL_RULES = [
    url_filter.site_rule("allow", "org", "/"),
    url_filter.site_rule("block", "example.org", "/es/"),
    url_filter.site_rule("block", "example.org", "/en/1"),
    url_filter.site_rule("allow", "com", "/fr/"),
    url_filter.site_rule("block", "com", "/de/"),
    url_filter.Rule("*.spam-**", "block"),
    url_filter.Rule("*.cheap-**", "block"),
    url_filter.Rule("*.casino?*.**", "block"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(load(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op4_url_filter"] = r"""
WITH parted AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), named AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parted
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
  END AS rule
  FROM named
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN contains('.' || host, '.spam-') OR contains('.' || host, '.cheap-')
      OR regexp_matches('.' || host || path, '^[^/]*\.casino[^/][^/]*\.') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op5_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(load(spark, sf_dir, "documents"), cycle=(1, 2, 3), cap=3.0)


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return secret_scan.digest_documents(docs, secret_scan.learn(docs))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_documents(load(spark, sf_dir, "documents"))


@query
def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return site_quality.scored(docs, site_quality.learn(docs, load(spark, sf_dir, "labels")), host="source", path="lang")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_documents(load(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(load(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def _codes_sql(rounds: int) -> str:
    """Assignment and means written out a round after the other."""
    sql = """
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT ceil(max(len(x)) / 16)::BIGINT AS w FROM k
), v AS (
  SELECT r, p, list_transform(range(p * w + 1, p * w + w + 1), lambda i: coalesce(x[i], 0)) AS x
  FROM k, w, range(16) AS parts(p)
), c0 AS (SELECT p, r - 1 AS e, x FROM v WHERE r <= 64"""
    near = """SELECT p, r, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT v.p, v.r, c.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) ** 2))::BIGINT AS d
    FROM v JOIN c{0} c ON c.p = v.p) GROUP BY p, r"""
    for t in range(rounds):
        sql += f"""
), n{t} AS ({near.format(t)}
), s{t} AS (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS x FROM (
    SELECT v.p, m.e AS e, i, sum(v.x[i]) AS s, count(*) AS n
    FROM v JOIN n{t} USING (p, r), w, range(1, w + 1) AS places(i) GROUP BY ALL) GROUP BY p, e
), c{t + 1} AS (SELECT p, e, coalesce(s{t}.x, c{t}.x) AS x FROM c{t} LEFT JOIN s{t} USING (p, e)"""
    return sql + f"""
), last AS ({near.format(rounds)}
), coded AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN coded USING (r)
"""


ORACLES["op11_vector_codes"] = _codes_sql(2)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"), least=100, top=2000, longest=5)


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM pieces
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, range(1, 6) AS ks(k)
), f AS (
  SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, p, f AS a FROM f WHERE k > 1 AND f >= 100
), cuts AS (
  SELECT c.lang, c.k, c.p, c.a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN range(1, 5) AS js(j) ON j < c.k JOIN t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1:c.k]
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), named AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM worst
), stay AS (
  SELECT * FROM named s WHERE NOT EXISTS (
    SELECT 1 FROM named d WHERE d.lang = s.lang AND d.k > s.k AND 100 * d.a >= 100 * s.a AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM stay QUALIFY rank <= 2000
"""


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_documents(load(spark, sf_dir, "documents"), length=200)


ORACLES["op13_suffix_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents
), w AS (
  SELECT r, i, md5(t[i + 1:i + 200]) AS k FROM d, unnest(range(0, greatest(octet_length(t) - 199, 0))) AS places(i)
), twice AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), starts AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN twice USING (k)
), runs AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM starts
), spans AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY r, run
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS kept_from FROM spans
), cut AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(hex(t[kept_from + 1:a]), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN t ELSE unhex(kept || hex(t[last + 1:octet_length(t)])) END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
