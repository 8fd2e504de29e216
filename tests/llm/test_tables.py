"""Operators over whole tables: Jaccard join, URL filter, top-k, mixing, site quality, the pipeline."""

import math
import random
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import SF, WORD, groups, rows_of, shingles, water
from pyspark.sql import functions as F

import corpus_pipeline
from hourcast.llm import jaccard_join, mixing, site_quality, topk, url_filter
from hourcast.llm import queries as registered


def near_copies(seed=4):
    """Groups of exact and near copies, chains, a shared passage in unlike texts, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(6):
        first = [word() for _ in range(rng.choice([30, 80, 200]))]
        texts.append(first)
        for _ in range(25):
            copy = list(first)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    chain = [word() for _ in range(100)]
    for i in range(0, 60, 3):
        chain = chain[:i] + [word()] + chain[i + 1 :]
        texts.append(list(chain))
    texts += [[word() for _ in range(rng.randrange(5, 40))] + passage for _ in range(60)]
    texts += [[word() for _ in range(rng.randrange(1, 7))] for _ in range(30)] + [["a", "b"], ["A", "B"], ["a", "b", "c"]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("stars,often", [(6, 1 / 128), (1, 1 / 4)])
def test_jaccard_is_brute_force(spark, monkeypatch, stars, often):
    monkeypatch.setattr(jaccard_join, "STARS", stars)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "HELD", 500)
    rows = near_copies()
    got = rows_of(jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, len(shingles(t)), g) for (i, t), g in zip(rows, groups(rows))), key=repr)


def test_jaccard_frequent_shingles_skip_the_fragments(spark, monkeypatch):
    """A line that every document has is found beforehand, and results do not change."""
    rng = random.Random(5)
    line = "one line that stands in all of the documents of this table and is long enough to count"
    rows = [(i, line + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(4))) for i in range(300)]
    rows += [(300 + i, line + f" tail{i % 7}") for i in range(60)]
    seen = []
    whole = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda size, fragments, often: (seen.append(len(often)), whole(size, fragments, often))[1])
    got = rows_of(jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), "doc_id", "component_id")
    assert seen[0] > 5
    assert got == sorted(((i, g) for (i, _), g in zip(rows, groups(rows))), key=repr)


def test_jaccard_cases(tricky, empty):
    rows = [(r["doc_id"], r["text"]) for r in tricky.select("doc_id", "text").collect()]
    light = [(i, t if len(t or "") < 10_000 else t[:6] * 50) for i, t in rows]
    want = [(i, g if g is not None else i) for (i, _), g in zip(rows, groups(light))]
    assert rows_of(jaccard_join.join_documents(tricky), "doc_id", "component_id") == sorted(want, key=repr)
    assert jaccard_join.join_documents(empty).count() == 0


def test_contraction(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 3)]
    got = dict(rows_of(jaccard_join.contracted(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def glob_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return re.compile("".join({"**": r"[\s\S]*", "*": r"[^/]*", "?": r"[^/]"}.get(p, re.escape(p)) for p in parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*?.é", min_size=1, max_size=9), min_size=1, max_size=20), st.lists(st.text("ab/.é", max_size=12), max_size=8))
def test_automaton_is_the_regex(globs, texts):
    got = url_filter.Automaton(globs).matches([t.encode() for t in texts])
    # a star run of three is "**" and "*", which is "**"
    want = [[glob_regex(re.sub(r"\*\*\*+", "**", g)).fullmatch(t) is not None for g in globs] for t in texts]
    assert got.tolist() == want


def test_star_behind_a_question_mark():
    got = url_filter.Automaton(["?*", "a?*b", "?**"]).matches([x.encode() for x in ("aa", "é", "éé/", "axyzb", "a/b", "")])
    assert got.tolist() == [[True, False, True], [True, False, True], [False, False, True], [True, True, True], [False, False, True], [False, False, False]]


def test_url_filter_cases(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG", "https://A.Example.ORG/", "ftp://example.org/es/x?y#z", "http://x.example.org/en/12", "http://notexample.org/es/1",
            "http://evil.net/a.org/x", "http://shop.com/fr/", "http://shop.com/fr", "http://a.com?x=/de/", "http://é.com/de/ß", "x://y://z.org/", "http://b.spam-farm.net/x", "http://org/q", "http://l.net/" + "a" * 20000,
            "http://m.casino-win.example.com/en/4033.html", "http://casino.net/x", "http://casinos.net/x", "http://www.casino1/a.b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for r in url_filter.filter_urls(pages, registered.URL_RULES).collect():
        u = urls[r["page_id"]]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = ".spam-" in "." + host or re.match(r"[^/]*\.casino[^/][^/]*\.", "." + host + path)
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "block" if bad else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), u
    assert url_filter.filter_urls(pages.limit(0), registered.URL_RULES).count() == 0
    assert url_filter.filter_urls(pages, []).where("verdict <> 'allow'").count() == 0


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    rng = np.random.default_rng(6)
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [f32(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(30)]  # ties
    rows += [(450, None), (500, [1.0, None] + [0.0] * 6), (501, [float("nan")] * 8), (502, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (550, []), (100, [-x for x in rows[100][1]]), (60, rows[60][1]), (100, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(5)
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, mine) in enumerate(ok):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for m, (i, v) in enumerate(ok) if m != n)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(50, [1e30, 0.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert len(rows_of(topk.top_k(df.where("vec_id in (50, 61, 70)"), F.col("vec_id") % 50 == 0), "rank")) == 2


def test_top_k_stops_early():
    """The bound order leaves most candidates unscored when the vectors lie in clusters."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 400
    v = np.rint(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.int64)
    p = v[:24].astype(float)
    far = lambda a: np.sqrt(((a[:, None, :] - p[None]) ** 2).sum(2))
    ids = np.arange(4000)
    got = sorted((int(ids[q]), int(ids[c]), s) for q, c, s in topk.best(5, v[:3], v, far(v[:3].astype(float)), far(v.astype(float)), ids, ids[:3], ids))
    for q in range(3):
        s = sorted((-int(v[q] @ v[i]), i) for i in range(4000) if i != q)[:5]
        assert sorted((i, -x) for x, i in s) == [(i, x) for a, i, x in got if a == q]


def test_top_k_blocks_take_no_more_than_their_vectors(spark, monkeypatch):
    """What is copied to every shard is a query's components in the smallest integers, its id and its row."""
    frames, packed = [], topk.packed
    monkeypatch.setattr(topk, "packed", lambda *a: frames.append(packed(*a)) or frames[-1])
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=64) / 8]) for i in range(2000)]
    topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    for frame, n in zip(frames, (2000, 40)):
        got = [{k: v for k, v in r.asDict().items() if isinstance(v, (bytes, bytearray))} for r in frame.collect()]
        assert sum(len(r["ids"]) for r in got) == 8 * n and sum(len(b) for r in got for b in r.values()) <= (2 * 64 + 16) * n


@pytest.mark.parametrize("make", ["few", "same", "wide", "clusters"])
def test_top_k_tiles_are_brute_force(monkeypatch, make):
    """Many tiles: equal vectors in all of them, scores beyond 53 bits, tiles that no query needs."""
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "TILE", 100)
    rng = np.random.default_rng(9)
    v = np.floor(rng.normal(size=(1500, 16)) * (8e7 if make == "wide" else 40)).astype(np.int64)
    if make == "few":
        v = v[rng.integers(0, 60, len(v))]
    if make == "same":
        v[rng.random(len(v)) < 0.5] = v[0]
    if make == "clusters":
        v += np.floor(rng.normal(size=(20, 16)) * 4000).astype(np.int64)[rng.integers(0, 20, len(v))]
    ids, rows, asked = rng.permutation(len(v)) // 2, np.arange(len(v)), rng.choice(len(v), 200, replace=False)
    p = v[:24].astype(float)
    far = np.sqrt(((v[:, None, :].astype(float) - p[None]) ** 2).sum(2))
    got = topk.best(5, v[asked], v, far[asked], far, ids, rows[asked], rows)
    want = []
    for n, a in enumerate(asked.tolist()):
        s = sorted((-int(x), i, r) for x, i, r in zip(v @ v[a], ids.tolist(), rows.tolist()) if r != a)[:5]
        want += [(n, r, -x) for x, _, r in s]
    assert sorted((int(q), int(c), int(s)) for q, c, s in got) == sorted(want)


@pytest.mark.parametrize("table", ["tricky", "small"])
def test_mixing(request, table):
    docs = request.getfixturevalue(table)
    rows = mixing.mixed(docs).collect()
    texts = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in rows), key=repr) == sorted(texts, key=repr)
    sizes = {}
    for _, s, n in texts:
        sizes[s] = sizes.get(s, 0) + n
    target = water(sizes)
    for s, size in sizes.items():
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size and abs(r["target"] - target[s]) <= 1e-6 * (1 + target[s]) for r in mine)
        assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in mine)
        taken = sum(r["taken"] for r in mine)
        # off by half of the smallest document that could have come closer, at most
        assert abs(taken - target[s]) <= max(r["size"] for r in mine)
    again = mixing.mixed(docs.repartition(7)).collect()
    key = lambda r: repr((r["doc_id"], r["source"], r["size"], r["taken"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixing_copies(small, empty):
    want = {}
    for r in mixing.mixed(small).collect():
        if r["taken"]:
            want[r["doc_id"]] = r["copies"]
    got = mixing.copies_of(small)
    assert got.columns == small.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == want
    assert mixing.mixed(empty).count() == 0 and mixing.copies_of(empty).columns == empty.columns


def test_pareto_ranks_follow_the_probabilities(spark):
    """Over many documents the share taken of a size class is near its inclusion probability."""
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 40)), "a" if i < 4000 else "b") for i in range(8000)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), cycle=(1, 2)).toPandas()
    a = out[out.source == "a"]
    share = a.groupby("size").copies.mean()
    rest = a.target.iloc[0] - a.source_size.iloc[0] * math.floor(a.target.iloc[0] / a.source_size.iloc[0])
    c = rest / sum(m * w for m, w in ((mixing_class(s), 2000 * s) for s in (10, 40)))
    for s in (10, 40):
        assert abs(share[s] - c * mixing_class(s)) < 0.05


def mixing_class(size):
    return 2 ** (math.floor(8 * math.log2(size)) / 8)


def test_site_quality(tricky, empty, small, labels):
    weights = site_quality.learn(small, labels)
    for docs in (tricky, small):
        out = site_quality.scored(docs, weights)
        assert out.count() == docs.count() and out.where("score is null or p_path is null or score < 0 or score > 1").count() == 0
    assert site_quality.scored(tricky, weights).where("doc_id in (5, 6, 7) and kept").count() == 0
    assert site_quality.scored(empty, weights).count() == 0
    assert site_quality.learn(small, labels.limit(0)) is None
    assert site_quality.scored(small, None).where("not kept").count() == 0


def test_site_posteriors_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.9)] * 300 + [("bad", "a", 0.1)] * 500 + [("tiny", "a", 0.1)] + [(None, None, 0.8)] * 50
    got = {(r["host"], r["path"]): r for r in site_quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    whole = sum(r[2] for r in rows) / len(rows)
    assert abs(got["big", "a"]["p_all"] - whole) < 1e-9
    assert got["big", "a"]["p_path"] > 0.85 and got["bad", "a"]["p_path"] < 0.15
    assert 0.1 < got["tiny", "a"]["p_path"] < whole  # one document moves a site part of the way
    assert (None, None) in got


def test_site_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = site_quality.scored(docs, site_quality.learn(docs, labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95 and got.kept[got.quality == 1].mean() > 0.98


def test_pipeline(spark, small):
    """Every stage against what its operator decides on the stage's own input."""
    docs = small
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name == "quality":
            kept = site_quality.scored(docs, site_quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept")
            assert rows_of(out, "doc_id") == rows_of(kept, "doc_id") and 0 < out.count() < docs.count()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert rows_of(out, "doc_id") == sorted(((i,) for i in set(groups(rows))), key=repr)
        if name == "secrets":
            assert out.where("text rlike '[0-9a-f]{32}'").count() == 0
            assert rows_of(out.where("not contains(text, '[SECRET]')"), "doc_id", "text") == rows_of(docs.join(out.where("not contains(text, '[SECRET]')"), "doc_id", "left_semi"), "doc_id", "text")
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "mix":
            taken = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).collect() if r["taken"]}
            assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == taken
        if name == "tokens":
            assert out.count() == docs.count() and out.where("n_tokens <> size(token_ids)").count() == 0
        else:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(9)
    base = {n: [f"{n}{rng.randrange(10**6)}" for _ in range(60)] for n in "abcd"}
    text = lambda n, last="": " ".join(base[n][:-1] + [last or base[n][-1]])
    rows = [(1, text("a")), (5, text("a", "near")), (5, text("b")), (7, text("c")), (7, text("d")), (7, text("d"))]
    rows += [(None, "no id " + text("b", "x")[::-1])] * 50 + [(None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash"))
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SF)
        want = [(1, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (None, rows[6][1]), (None, ""), (None, "")]
        assert out.columns == docs.columns and rows_of(out, "doc_id", "text") == sorted(want, key=repr)


def test_near_duplicates_work_a_key_out_once(spark, small):
    """No stage holds the key's function twice, above and below a filter: that took a second worker a task."""
    out = corpus_pipeline.near_duplicates(spark, small, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3  # of rows with words, without, and without an id


def test_pipeline_secrets_learn_from_all_texts(spark):
    """What texts without credentials hold is ordinary text for the stage that masks secrets."""
    number = lambda i: str(i * 7919 % 10**8 + 10**8) * 2
    rows = [(0, "prose")] + [(i, f"prose token = {number(i)} end") for i in range(1, 61)] + [(i, f"order {number(i)}") for i in range(61, 361)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    assert out == {i: t if i < 1 or i > 60 else "prose [SECRET] end" for i, t in rows}


def test_pipeline_cases(spark, tricky, empty, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (tricky, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "tokens" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_registered():
    names = list(registered.QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(registered.ORACLES) <= set(names)


def test_site_scores_equal_brute_force(spark, small, labels):
    """Host and path posteriors, and what they do to a document, restated a row at a time."""
    from llm_brute import site_scores

    weights = site_quality.learn(small, labels)
    docs = small.withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    got = site_quality.scored(docs.unionByName(docs.where("doc_id % 3 = 0")), weights).collect()
    want = site_scores([(r["host"], r["path"], r["p_doc"]) for r in got], site_quality.SWAY, site_quality.KEEP)
    assert len({(r["host"], r["path"]) for r in got}) > 8
    for r, (p_host, p_path, score, kept) in zip(got, want):
        assert (r["p_host"], r["p_path"], r["score"]) == pytest.approx((p_host, p_path, score), rel=1e-9)
        assert r["kept"] == kept
