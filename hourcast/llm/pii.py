"""Operator 8: PII by information-theoretic sanitisation, in DataFrame functions alone.

Plain patterns find the protected entities: emails, IPs, cards, phones. What else
reveals an entity c is estimated from the corpus: a term t in the documents of c
discloses it as far as their pointwise mutual information reaches the entity's
information content,

    PMI(c, t) = ln(N n_ct / (n_c n_t)),  IC(c) = ln(N / n_c),

with n_t, n_c the documents that hold t and c, n_ct those that hold both, wherever
in the text, N all documents. Terms from ``disclose`` * IC on are generalised, from
``remove`` * IC on removed, if at least ``support`` documents say so: every
occurrence outside of entities in every text, with or without the entity. A term
that occurs as often without the entity stays.

Spans are (start, kind, end) in code points, end exclusive. Kinds in order: email,
ip, card, phone, then term for what the estimate adds.

Cases: null text is empty and has no spans; texts are read whole; equal rows count
as documents each and get the same spans; null ids are carried along; an empty
table gives no rows. Patterns are written without backtracking over runs, so long
runs of digits or letters cost linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "term")
#: A run is entered at its start or where the last match ended; inside, every start would end the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a text must hold before its runs are looked at.
HINT = (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", r"\+[0-9]")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Matches whose offsets are summed together.
BLOCK = 128
#: Terms, and the pieces that a text is read in: no piece ends within a run of letters.
TERM, PIECE = r"\p{L}{3,}", r"[\s\S]{1,1000}+\p{L}*+"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match: the matches and the gaps between them add up to the text.

    Offsets are summed per block of matches and inside of a block, so a text of very many matches costs
    little more than its length."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the gap before each match, then the match; the last gap has none
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value"), F.coalesce(F.length(m), F.lit(0)).alias("n")))

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0), lambda at, x: at + x["gap"] + x["n"])

    def starts(blocks: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, b: F.struct((s["at"] + total(b)).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(blocks, state, step, lambda s: s["out"])

    def block(rows: Column, at: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = at + total(F.slice(rows, F.lit(1), i)) + x["gap"]
            return F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value"))

        return F.transform(rows, span)

    def body(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
        return bound(blocks, lambda cut: F.flatten(F.zip_with(cut, starts(cut), block)))

    return F.filter(bound(both, body), lambda s: s["value"].isNotNull())


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    backwards = F.reverse(number)
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.struct(i.alias("i"), F.substring(backwards, i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x["i"] % 2 == 1, x["d"]).when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"]))
    return total % 10 == 0


def valid(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    number = digits(value)
    if kind == 2:
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))
    return F.length(number).between(9, 15)


def plain(text: Column) -> Column:
    """(start, kind, end, value) of the protected entities, by start and kind."""
    def of(k: int, pattern: str) -> Column:
        good = F.filter(placed(text, pattern), lambda s: valid(k, s["value"]))
        spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(text.rlike(HINT[k]), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))

    return F.array_sort(F.concat(*(of(k, p) for k, p in enumerate((EMAIL, IP, CARD, PHONE)))))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def occurrences(rows: DataFrame) -> DataFrame:
    """(row_no, term, start, end) of every occurrence of a term. Texts are read in pieces, for offsets
    are carried along a list that is copied as it grows."""
    def walked(parts: Column, kind: str, size, put) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<{kind}>>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + size(x)).alias("at"), put(s, x).alias("out"))
        return F.aggregate(parts, state, step, lambda s: s["out"])

    pieces = walked(F.regexp_extract_all("_text", F.lit(PIECE), F.lit(0)), "at:int,piece:string", F.length, lambda s, x: F.array_append(s["out"], F.struct(s["at"].alias("at"), x.alias("piece"))))
    cut = rows.select("row_no", F.explode(pieces).alias("p")).select("row_no", "p.*")
    # the gap before each term, then the term; the last gap has none
    both = F.zip_with(F.split("piece", TERM, -1), F.regexp_extract_all("piece", F.lit(TERM), F.lit(0)), lambda g, t: F.struct(F.length(g).alias("gap"), t.alias("t"), F.coalesce(F.length(t), F.lit(0)).alias("n")))

    def put(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        return F.when(x["t"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct(F.lower(x["t"]).alias("term"), start.alias("start"), (start + x["n"]).alias("end"))))

    found = walked(both, "term:string,start:int,end:int", lambda x: x["gap"] + x["n"], put)
    return cut.select("row_no", "at", F.explode(found).alias("t")).select("row_no", "t.term", (F.col("at") + F.col("t.start")).alias("start"), (F.col("at") + F.col("t.end")).alias("end"))


def disclosing(rows: DataFrame, disclose: float, remove: float, support: int) -> DataFrame:
    """(term, removed) of the terms that reveal an entity.

    Entities of the same documents are one class: whatever reveals one reveals all."""
    named = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"].cast("string"), s["value"])))
    said = rows.where(F.size("base") > 0)
    held = said.select("row_no", F.explode(named).alias("entity"))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "row_no")).alias(f"h{seed}") for seed in (1, 2)]
    entities = held.groupBy("entity").agg(F.count("*").alias("n_c"), *same).where(F.col("n_c") >= support)
    classes = held.join(entities, "entity").groupBy("row_no").agg(F.collect_set(F.struct("n_c", "h1", "h2")).alias("classes"))
    words = said.select("row_no", terms_of(F.col("_text")).alias("terms")).join(classes, "row_no")
    pairs = words.select("terms", F.explode("classes").alias("c")).select("c", F.explode("terms").alias("term"))
    both = pairs.groupBy("c", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= support)
    counts = rows.select(F.explode(terms_of(F.col("_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support)
    n = float(rows.count())
    pmi = F.ln(F.lit(n) * F.col("n_ct") / (F.col("c.n_c") * F.col("n_t")))
    content = F.ln(F.lit(n) / F.col("c.n_c"))
    told = both.join(counts, "term").select("term", pmi.alias("pmi"), content.alias("ic")).where((F.col("ic") > 0) & (F.col("pmi") >= disclose * F.col("ic")))
    return told.groupBy("term").agg(F.max(F.col("pmi") >= remove * F.col("ic")).alias("removed"))


def found(docs: DataFrame, text: str = "text", disclose: float = 0.9, remove: float = 0.999, support: int = 2, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, base, spans, removed) of every row: the entities; all spans; the starts of the terms to
    remove. With ``carry``, those columns of ``docs`` as one struct column ``row``."""
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), whole.alias("_text"), *more)
    rows = stored(rows.withColumn("base", plain(F.col("_text"))), "pii-entities")

    # stored, so that its size is known: a small list is broadcast, a large one joined by term
    reveal = stored(disclosing(rows, disclose, remove, support), "pii-terms")
    # only texts that hold such a term are read for its places
    held = rows.select("row_no", F.explode(terms_of(F.col("_text"))).alias("term")).join(reveal.select("term"), "term", "left_semi")
    held = stored(held.select("row_no").distinct(), "pii-rows")
    told = occurrences(rows.join(held, "row_no", "left_semi").select("row_no", "_text")).join(reveal, "term")
    terms = told.groupBy("row_no").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "removed")).alias("terms"))
    both = rows.drop("_text").join(terms, "row_no", "left")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")
    free = F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    terms = F.coalesce(free, none)
    extra = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    gone = F.transform(F.filter(terms, lambda s: s["removed"]), lambda s: s["start"])
    return both.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, extra)).alias("spans"), gone.alias("removed"), *(["row"] if carry else []))


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_documents(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found(docs, **settings).select("doc_id", *map(count, range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms by ``[TERM]`` or, where they give
    the entity away, by nothing. Null texts stay null."""
    rows = found(docs, text=text, carry=docs.columns, **settings)
    whole = F.col(f"row.`{text}`")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mark = F.when(F.array_contains("removed", x["start"]) & (x["kind"] == 4), F.lit("")).otherwise(F.element_at(names, x["kind"] + 1))
        put = F.concat(s["out"], F.substring(whole, s["at"] + 1, x["start"] - s["at"]), mark)
        inside = x["start"] < s["at"]  # starts in a span that is already replaced
        return F.struct(F.when(inside, F.greatest(s["at"], x["end"])).otherwise(x["end"]).alias("at"), F.when(inside, s["out"]).otherwise(put).alias("out"))

    done = F.aggregate("spans", state, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole))))
    clean = F.when(F.size("spans") > 0, done).otherwise(whole)
    return rows.select(*(clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
