"""Operator 12: collocations by best-first branch-and-bound growth.

Phrases of 2 to 5 words are scored at their weakest cut, 1000 * a * n / (l * r). A
phrase is never more frequent than the rest behind its first word, so the count of
that word bounds the score of every phrase that grows from it: 1000 * n / f(word).
Words wait in the order of this bound. A step expands the best of them a word at a
time, keeps the prefixes that stay frequent, scores what has grown, and takes the
score of each language's last place among the phrases found so far. Words whose
bound lies below it are never expanded; those that reach it, ties included, are
expanded in the next step, after which none is left.

A step counts by passes over the texts. Tasks receive the frequent prefixes as bit
filters of at most ``BITS`` bits, whatever their number; a filter lets too much
pass, never too little, and counts are exact. A phrase is inside of a longer one as
often as it occurs if all its places have the same word before it, or after it; so
every count carries the smallest and largest neighbour.

Texts are read once and kept as codes of their words. Words have 64-bit numbers, which
are checked: if two words share one, all words are numbered anew.

Cases: null and empty texts have no words; null languages are ``und``; repeated
rows, ids included, count each; long texts are read whole; equal scores are ordered
by count, then phrase; an empty table, or one without frequent phrases, gives no
rows; columns beyond text and language are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import stored

#: Bits of a filter at most (8 MB).
BITS = 1 << 26
#: Words and piece ends in a row of numbered text, different words in it at most, and places worked on together.
CHUNK, MEMORY, SLICE = 4_000_000, 1_000_000, 500_000
#: Pairs held before they are sent on.
HELD = 2_000_000
#: The first step expands the best words that hold one in so many of a language's frequent words.
FIRST = 4
LONGEST = 5

#: Piece ends become a line end, A-Z become small letters.
FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256)).lower()
MIX, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Memo(dict):
    """Words of a language in a chunk and their codes; codes of a chunk are counted through, 0 ends a piece."""

    def __init__(self, size: list[int]):
        super().__init__({b".": 0})  # no word is a full stop
        self.size = size

    def __missing__(self, word):
        self.size[0] += 1
        self[word] = code = self.size[0]
        return code


def word_numbers(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    key = f"{seed:016x}"
    raw = pd.util.hash_array(np.array([f"{lang}\0".encode() + w for w in words], dtype=object), hash_key=key, categorize=False)
    return np.where(raw == 0, np.uint64(1), raw)


NUMBERED = "codes binary, size long, words array<struct<lang:string,word:string,t:long,f:long>>"
WORD = pa.struct([("lang", pa.string()), ("word", pa.string()), ("t", pa.int64()), ("f", pa.int64())])


def number_texts(seed: int):
    """Texts as codes of their words, a row of about ``CHUNK`` of them, with what the codes stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, memos, parts = [0], {}, []

        def chunk():
            codes = np.concatenate(parts)
            times = np.bincount(codes, minlength=size[0] + 1)
            rows: list[tuple] = [()] * size[0]
            for lang, memo in memos.items():
                words = [w for w in memo if w != b"."]
                t = word_numbers(lang, words, seed).view(np.int64).tolist() if words else []
                for w, n in zip(words, t):
                    code = memo[w]
                    rows[code - 1] = (lang, w.decode("utf-8", "surrogatepass"), n, int(times[code]))
            words = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], WORD.field(j).type) for j in range(4)], fields=list(WORD))
            body = pa.Codec("zstd", 3).compress(codes.astype("<i4").tobytes(), asbytes=True)
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), words)
            out = pa.RecordBatch.from_arrays([pa.array([body], pa.binary()), pa.array([len(codes)]), listed], ["codes", "size", "words"])
            size[0] = 0
            memos.clear()
            parts.clear()
            return out

        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by.setdefault("und" if lang is None else lang, []).append(text)
            for lang, texts in by.items():
                joined = "\n".join(texts).encode("utf-8", "surrogatepass").translate(FOLD)
                words = joined.replace(b"\n", b" . ").split()
                memo = memos.get(lang)
                if memo is None:
                    memo = memos[lang] = Memo(size)
                parts += [np.fromiter(map(memo.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
            if sum(map(len, parts)) >= CHUNK or size[0] >= MEMORY:
                yield chunk()
        if parts:
            yield chunk()

    return run


class Slice:
    """A stretch of numbered text: its places, one before them and ``LONGEST`` + 1 behind them."""

    def __init__(self, codes: np.ndarray, table: np.ndarray):
        self.codes, self.table = codes, table
        self.n = len(codes) - LONGEST - 1

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of word pairs by flags of the first and the second word's code."""
        return np.flatnonzero(first[self.codes[1 : self.n]] & second[self.codes[2 : self.n + 1]]) + 1

    def number(self, at: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the k-word phrases at places that have so many words in their piece."""
        out = self.table[self.codes[at]]
        for j in range(1, k):
            out = self.longer(out, at, j)
        return out

    def longer(self, number: np.ndarray, at: np.ndarray, j: int) -> np.ndarray:
        return mixed(number * NEXT + self.table[self.codes[at + j]]) | np.uint64(1)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Iterator[Slice]]]:
    """(word numbers by code, slices) of every chunk; number 0 is that of piece ends."""
    for i in range(batch.num_rows):
        size = batch.column(1)[i].as_py()
        codes = np.frombuffer(pa.Codec("zstd").decompress(batch.column(0)[i].as_buffer(), size * 4, asbytes=True), "<i4")
        codes = np.concatenate([np.zeros(1, np.int32), codes, np.zeros(LONGEST + 1, np.int32)])
        table = np.append(np.uint64(0), batch.column(2)[i].values.to_numpy().astype(np.int64).view(np.uint64))
        yield table, (Slice(codes[at : at + SLICE + LONGEST + 2], table) for at in range(0, size, SLICE))


class Filter:
    """Two bits a number. It says yes to all that were put in, and to few others while it is not full."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def has(self, x: np.ndarray) -> np.ndarray:
        out = x != 0
        for shift in (0, 32):
            bit = (x >> np.uint64(shift)) & self.mask
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def filter_of(numbers: DataFrame) -> Filter:
    """The filter of the numbers in column ``g``; at most ``BITS`` / 64 rows reach the driver."""
    n = numbers.count()
    bits = 1 << 12
    while bits < BITS and bits < 32 * n:
        bits *= 2
    at = lambda shift: F.shiftrightunsigned("g", shift).bitwiseAND(F.lit(bits - 1))
    spots = numbers.select(F.explode(F.array(at(0), at(32))).alias("b"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    rows = spots.groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(mask).alias("m")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("i").to_numpy()] = rows.column("m").to_numpy()
    return Filter(words.view(np.uint64))


def phrase_numbers(phrases: DataFrame) -> DataFrame:
    """Column ``g``: the numbers of the phrases in column ``p``, as ``Slice.number`` makes them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                words = np.frombuffer(p, ">u8").astype(np.uint64)
                g = words[:1]
                for j in range(1, len(words)):
                    g = mixed(g * NEXT + words[j : j + 1]) | np.uint64(1)
                out.append(int(g.view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["g"])

    return phrases.select("p").mapInArrow(run, "g long")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def count_numbers(first: Filter, frequent: Filter):
    """(g, n): numbers of word pairs whose first word is expanded and whose second is frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            g, n = summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

        for batch in batches:
            for table, parts in slices(batch):
                starts, follows = first.has(table), frequent.has(table)
                for part in parts:
                    pair = part.number(part.places(starts, follows), 2)
                    held.append(summed(pair, np.ones(len(pair), np.int64)))
                    if sum(len(k) for k, _ in held) > HELD:
                        yield flush()
        if held:
            yield flush()

    return run


PHRASES = "p binary, f long, before_least long, before_most long, after_least long, after_most long"


def count_phrases(takes):
    """Counts and neighbours of the phrases that ``takes(table)(slice)`` names: (length, places) pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, parts in slices(batch):
                of = takes(table)
                for part in parts:
                    for k, at in of(part):
                        if len(at):
                            yield counted(part.table[part.codes[at[:, None] + np.arange(-1, k + 1)]])

    return run


def counted(t: np.ndarray) -> pa.RecordBatch:
    """Rows of word numbers, a neighbour at both ends, as phrases with their counts."""
    k = t.shape[1] - 2
    t = t[np.lexsort(t[:, 1:-1].T)]
    begin = np.flatnonzero(np.append(True, np.any(t[1:, 1:-1] != t[:-1, 1:-1], axis=1)))
    p = t[begin, 1:-1].astype(">u8").tobytes()
    before, after = t[:, 0].view(np.int64), t[:, -1].view(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array([p[i : i + 8 * k] for i in range(0, len(p), 8 * k)], pa.binary()), pa.array(np.diff(np.append(begin, len(t)))),
        *(pa.array(how.reduceat(x, begin)) for x in (before, after) for how in (np.minimum, np.maximum))],
        ["p", "f", "before_least", "before_most", "after_least", "after_most"])


class Growth:
    """Phrases counted so far, and the passes that count more."""

    def __init__(self, docs: DataFrame, least: int, longest: int):
        self.least, self.longest, self.spark = least, longest, docs.sparkSession
        seed, words = 0, None
        while words is None:
            # numbered once, read by every pass
            texts = stored(docs.mapInArrow(number_texts(seed), NUMBERED), "collocation-texts")
            words = texts.selectExpr("inline(words)").groupBy("lang", "word", "t").agg(F.sum("f").alias("f"))
            words = stored(words, "collocation-words")
            shared = words.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
            if shared.limit(1).count():
                seed, words = seed + 1, None
        self.texts = texts.select("codes", "size", F.col("words.t").alias("t"))
        self.totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        # phrases are rows of 8 bytes a word; one word is a phrase of length 1
        often = words.where(F.col("f") >= least)
        self.words = stored(often.join(self.totals, "lang").select(word_key(F.col("t")).alias("p"), "t", "lang", "f", "word", "n"), "collocation-frequent")
        self.frequent = filter_of(self.words.select(F.col("t").alias("g")))
        self.phrases: list[DataFrame] = []
        self.pairs: list[DataFrame] = []

    def passed(self, takes) -> DataFrame:
        raw = self.texts.mapInArrow(count_phrases(takes), PHRASES)
        aggs = [F.min(c).alias(c) if c.endswith("least") else F.max(c).alias(c) for c in ("before_least", "before_most", "after_least", "after_most")]
        out = raw.groupBy("p").agg(F.sum("f").alias("f"), *aggs).where(F.col("f") >= self.least)
        return stored(out, "collocation-phrases")

    def expand(self, batch: DataFrame, waiting: DataFrame) -> None:
        """Count all frequent phrases that grow from the words of ``batch``; ``waiting`` words are not expanded yet."""
        first, frequent = filter_of(batch.select(F.col("t").alias("g"))), self.frequent
        later = filter_of(waiting.select(F.col("t").alias("g")))
        numbers = self.texts.mapInArrow(count_numbers(first, frequent), "g long, n long")
        numbers = numbers.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= self.least).select("g")
        self.pairs.append(stored(numbers, "collocation-pairs"))
        pair = filter_of(self.pairs[-1])
        every = pair if len(self.pairs) == 1 else filter_of(union(self.pairs))
        longest = self.longest

        def short(table: np.ndarray):
            starts, follows, waits = first.has(table), frequent.has(table), later.has(table)

            def of(part: Slice):
                at = part.places(starts, follows)
                at = at[pair.has(part.number(at, 2))]
                yield 2, at
                if longest > 2:
                    # the last word is frequent, the last two are, as far as that is known
                    at = at[follows[part.codes[at + 2]]]
                    yield 3, at[waits[part.codes[at + 1]] | every.has(part.number(at + 1, 2))]

            return of

        grown = self.passed(short)
        self.phrases.append(grown)
        for k in range(4, longest + 1):
            prefix = filter_of(phrase_numbers(grown.where(F.length("p") == 8 * (k - 1))))

            def longer(table: np.ndarray, k=k, prefix=prefix):
                starts, follows = first.has(table), frequent.has(table)

                def of(part: Slice):
                    at = part.places(starts, follows)
                    g = part.number(at, 2)
                    on = pair.has(g)
                    at, g = at[on], g[on]
                    for j in range(2, k):
                        if j == k - 1:
                            on = prefix.has(g)
                            at, g = at[on], g[on]
                        on = follows[part.codes[at + j]]
                        at, g = at[on], g[on]
                        g = part.longer(g, at, j)
                    yield k, at

                return of

            grown = self.passed(longer)
            self.phrases.append(grown)

    def counts(self) -> DataFrame:
        """(p, f, inside) of every phrase counted, words included; a phrase counted by two steps once."""
        inside = lambda a, b: (F.col(a) == F.col(b)) & (F.col(a) != 0)
        lone = inside("before_least", "before_most") | inside("after_least", "after_most")
        # the longest phrases are not inside of any other
        found = union(self.phrases).select("p", "f", ((F.length("p") < 8 * self.longest) & lone).alias("inside"))
        return found.dropDuplicates(["p"])

    def scored(self) -> DataFrame:
        """(lang, p, a, l, r, n, score, inside) of the phrases counted. Ends of phrases that no step has
        counted, as their first words wait, are counted here."""
        found = self.counts()
        cuts = found.select("p", "f", "inside", F.expr("explode(sequence(1, cast(length(p) / 8 as int) - 1)) as k"))
        cuts = cuts.select("p", "f", "inside", "k", F.expr("substring(p, 1, 8 * k)").alias("left"), F.expr("substring(p, 8 * k + 1)").alias("right"))
        known = self.words.select("p", "f").unionByName(found.select("p", "f"))
        missing = cuts.select(F.col("right").alias("p")).distinct().join(known, "p", "left_anti")
        missing = stored(missing, "collocation-missing")
        if missing.limit(1).count():
            wanted, longest, frequent = filter_of(phrase_numbers(missing)), self.longest, self.frequent
            begins = filter_of(phrase_numbers(missing.select(F.expr("substring(p, 1, 16)").alias("p")).distinct()))

            def ends(table: np.ndarray):
                follows = frequent.has(table)

                def of(part: Slice):
                    at = part.places(follows, follows)
                    g = part.number(at, 2)
                    on = begins.has(g)
                    at, g = at[on], g[on]
                    for k in range(2, longest):
                        yield k, at[wanted.has(g)]
                        on = follows[part.codes[at + k]]
                        at, g = at[on], g[on]
                        g = part.longer(g, at, k)

                return of

            known = known.unionByName(self.passed(ends).join(missing, "p", "left_semi").select("p", "f"))
        left = known.select(F.col("p").alias("left"), F.col("f").alias("l"))
        right = known.select(F.col("p").alias("right"), F.col("f").alias("r"))
        lang = self.words.select(F.col("p").alias("w"), "lang", "n")
        rows = cuts.join(left, "left").join(right, "right").withColumn("w", F.expr("substring(p, 1, 8)")).join(lang, "w")
        over = "cast(1000 * cast(f as decimal(19,0)) as decimal(22,0)) * cast(n as decimal(15,0))"
        rows = rows.withColumn("score", F.expr(f"({over}) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
        worst = F.min(F.struct("score", "k", "l", "r")).alias("c")
        out = rows.groupBy("lang", "p", F.col("f").alias("a"), "n", "inside").agg(worst)
        return stored(out.select("lang", "p", "a", "c.l", "c.r", "n", "c.score", "inside"), "collocation-scores")


def word_key(t: F.Column) -> F.Column:
    """A word number as its 8 bytes, highest first."""
    return F.unhex(F.lpad(F.hex(t), 16, "0"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_places(scored: DataFrame, top: int) -> DataFrame:
    """(lang, least): the score of place ``top`` among the phrases that stay, where there are so many."""
    rows = scored.where("not inside").select("lang", "p", "score")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(64))).orderBy(F.desc("score"))
    rows = rows.withColumn("i", F.row_number().over(part)).where(F.col("i") <= top)
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return rows.where(F.col("i") == top).select("lang", F.col("score").alias("least"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    growth = Growth(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), least, longest)
    # best bound first: the rarest words, up to a share of the language's frequent words by powers of two
    sized = growth.words.withColumn("e", F.floor(F.log2("f")))
    classes = sized.groupBy("lang", "e").agg(F.sum("f").alias("m"))
    before = F.sum("m").over(Window.partitionBy("lang").orderBy("e")) - F.col("m")
    classes = classes.withColumn("before", before).withColumn("all", F.sum("m").over(Window.partitionBy("lang")))
    best = sized.join(classes.where((F.col("before") == 0) | ((F.col("before") + F.col("m")) * FIRST <= F.col("all"))), ["lang", "e"])
    batch = stored(best.select("t"), "collocation-batch")
    waiting = stored(growth.words.join(batch, "t", "left_anti").select("t", "lang", "f", "n"), "collocation-waiting")
    growth.expand(batch, waiting)
    scored = growth.scored()
    bound = F.floor(F.lit(1000).cast("decimal(4,0)") * F.col("n").cast("decimal(19,0)") / F.col("f").cast("decimal(19,0)"))
    open_ = waiting.join(last_places(scored, top), "lang", "left")
    open_ = stored(open_.where(F.col("least").isNull() | (bound >= F.col("least"))).select("t"), "collocation-open")
    if open_.limit(1).count():
        growth.expand(open_, waiting.join(open_, "t", "left_anti"))
        scored = growth.scored()
    stay = scored.where("not inside").join(last_places(scored, top), "lang", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    places = stay.select("lang", "p", "a", "l", "r", "n", "score", F.expr("explode(sequence(1, length(p), 8))").alias("i"))
    spelt = places.withColumn("w", F.expr("substring(p, i, 8)")).join(growth.words.select(F.col("p").alias("w"), "word"), "w")
    spelt = spelt.groupBy("lang", "p", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x"))
    spelt = spelt.withColumn("phrase", F.array_join("x.word", " "))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(64))).orderBy(*order)
    spelt = spelt.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    spelt = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return spelt.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
