"""Operator 3: n-gram Jaccard join by vertical partitioning.

A document's set is its distinct word shingles, as 64-bit hashes; the order of
the hashes is the global order, and fragments are ranges of it.

1. Texts with the same words are one class, known by a hash of the words.
2. Every class is cut into its fragments. A fragment sees all sets' parts of one
   range, so it can tell which shingles two or more classes share. Only shared
   shingles can overlap: the shared parts are counted a fragment at a time and
   summed per class, and a class whose shared shingles cannot reach the threshold
   with anyone leaves (most of a corpus does).
3. The rest is indexed by prefix: shingles by rising frequency, unshared ones
   first; sets that reach the threshold share one of the first n - ceil(t n) + 1.
4. In each index list a few members are compared with all others, and what links
   becomes one component; lists inside one component are done. This is repeated
   until it links little; then all pairs that still cross components are compared,
   so no link that could join two components is passed over.
5. A comparison cuts both sets at the fragments, counts the partial overlaps
   separately, and sums them per pair.

Length, position and parity-bitmap bounds drop pairs before they are compared.
Shingles that lie in a large share of all documents are found beforehand and skip
the fragments (their order is last and common to all sets), so no fragment meets
a posting list of that size.

Cases: null text or a text without words has an empty set, n_shingles 0, links
with nothing and is its own component; fewer words than a shingle are one
shingle; rows with a null id keep null as component unless their class reaches
an id; repeated rows are one class; an empty table gives no rows; texts are read
whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import give_back, lean, stored

#: Shingles in a fragment of the first cut, at most about; fewest fragments; fragments of a comparison.
FRAGMENT, FRAGMENTS, PARTS = 2_500_000, 32, 16
#: Shingles a task holds before it hands its fragments on.
HELD = 1_000_000
#: A shingle in more than this share of a batch is a candidate for the list of frequent ones; half of it of all documents counts.
OFTEN = 1 / 128
#: Members of an index list that all others are compared with in a round; rounds at most; a round that links a smaller share of its comparisons is the last.
STARS, ROUNDS, WORTH = 6, 5, 0.02
#: Order of frequent shingles: after every counted one.
LAST = 65535

MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.lower`` changes these letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def class_key(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def shingles(words: list[bytes], size: int, hashes: WordHash) -> np.ndarray:
    """The set: sorted distinct 64-bit hashes of ``size`` words, or of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ h[i : i + len(out)]) * MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Number of the range that a hash lies in; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def described(text: Column, size: int) -> Column:
    """(key, n, often) of a text; ``often`` lists, in a batch's first row, its shingles that many of its classes have."""

    @F.pandas_udf("key long, n long, often array<long>, times array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for part in lean(texts):
            keys, sizes, sets, seen = [], [], [], set()
            for t in part:
                words = words_of(t)
                keys.append(class_key(words) if words else None)
                x = shingles(words, size, hashes)
                sizes.append(len(x))
                if words and keys[-1] not in seen:
                    seen.add(keys[-1])
                    sets.append(x)
            found, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            many = times >= max(8, OFTEN * len(part))
            rest = [None] * (len(part) - 1)
            yield pd.DataFrame({"key": pd.Series(keys, dtype="Int64"), "n": sizes, "often": [found[many].view(np.int64).tolist(), *rest], "times": [times[many].tolist(), *rest]})

    return run(text)


def cut(size: int, fragments: int, often: np.ndarray):
    """Texts to (frag, keys, sizes, counts, hashes): the parts of many classes in one range; frequent
    shingles under negative numbers that follow from the class."""

    def emit(sets: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.array([k for k, _ in sets], np.int64)
        sizes = np.array([len(x) for _, x in sets], np.int32)
        owner = np.repeat(np.arange(len(sets)), sizes)
        x = np.concatenate([x for _, x in sets])
        frag = fragment_of(x, fragments).astype(np.int64)
        if len(often):
            # frequent shingles go by class, not by range: no group meets one of them as a whole
            at = np.minimum(np.searchsorted(often, x), len(often) - 1)
            frag = np.where(often[at] == x, -1 - keys[owner] % fragments, frag)
        order = np.argsort(frag, kind="stable")  # a class's shingles stay together and in order
        frag, owner, x = frag[order], owner[order], x[order]
        names, edges = np.unique(frag, return_index=True)
        for f, lo, hi in zip(names.tolist(), edges, np.append(edges[1:], len(x))):
            who, counts = np.unique(owner[lo:hi], return_counts=True)
            yield row(f, keys[who], sizes[who], counts.astype(np.int32), x[lo:hi])

    def row(f: int, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"frag": pa.array([f], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in (("keys", keys), ("sizes", sizes), ("counts", counts), ("hashes", hashes))}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sets, held, seen = WordHash(), [], 0, set()
        for batch in lean(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if not words or (key := class_key(words)) in seen:
                    continue
                if len(seen) < 1_000_000:  # only saves work: fragments drop repeated classes anyway
                    seen.add(key)
                sets.append((key, shingles(words, size, hashes)))
                held += len(sets[-1][1])
                if held >= HELD:
                    yield from emit(sets)
                    sets, held = [], 0
        if sets:
            yield from emit(sets)
        sets, seen = [], set()
        give_back()

    return run


def shared(table: pa.Table) -> pa.Table:
    """A fragment: for each class its shingles here that another class has too, with their frequency."""
    def read(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(name)])

    keys, sizes, counts, x = read("keys", np.int64), read("sizes", np.int32), read("counts", np.int32), read("hashes", np.uint64)
    frag = table.column("frag")[0].as_py()
    _, first = np.unique(keys, return_index=True)
    if len(first) < len(keys):  # a class that several tasks have sent
        once = np.zeros(len(keys), bool)
        once[first] = True
        x, keys, sizes, counts = x[np.repeat(once, counts)], keys[once], sizes[once], counts[once]
    times = np.full(len(x), LAST, np.uint16)
    if frag >= 0:
        # some low bits at a time: what sorting needs stays small beside the fragment itself
        low = (x & np.uint64(15)).astype(np.uint8)
        for bits in range(16):
            at = np.flatnonzero(low == bits)
            _, place, n = np.unique(x[at], return_inverse=True, return_counts=True)
            times[at] = np.minimum(n, LAST - 1).astype(np.uint16)[place]
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
    common = times >= 2
    owner, x, times = owner[common], x[common], times[common]
    counts = np.bincount(owner, minlength=len(keys))
    ends = np.cumsum(counts)
    has = np.flatnonzero(counts)
    out = pa.table({
        "key": pa.array(keys[has], pa.int64()), "n": pa.array(sizes[has], pa.int32()), "s": pa.array(counts[has], pa.int32()),
        "hashes": pa.array([x[e - c : e].tobytes() for e, c in zip(ends[has], counts[has])], pa.binary()),
        "times": pa.array([times[e - c : e].tobytes() for e, c in zip(ends[has], counts[has])], pa.binary()),
    })
    del x, keys, sizes, counts, times, owner, common, ends, has
    give_back()
    return out


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def indexed(percent: int):
    """Classes to index rows: a class's first shingles in the order, with what the bounds need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            tokens, keys, sizes, at, own, bits = [], [], [], [], [], []
            for key, n, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x, times = joined(parts)
                order = np.lexsort((x, times))
                lead = len(x) - least_overlap(n, percent) + 1
                tokens.append(x[order[:lead]].view(np.int64))
                keys.append(np.full(lead, key, np.int64))
                sizes.append(np.full(lead, n, np.int32))
                at.append(n - len(x) + np.arange(lead, dtype=np.int32))
                # parity of the shared shingles in 256 places: differing bits are differing shingles at least
                odd = np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1
                bits.append(np.tile(np.packbits(odd.astype(np.uint8)).view(np.int64), (lead, 1)))
                own.append(np.full(lead, n - len(x), np.int32))
            if tokens:
                b = np.concatenate(bits)
                yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens), "key": np.concatenate(keys), "n": np.concatenate(sizes), "pos": np.concatenate(at), "own": np.concatenate(own), **{f"b{i}": b[:, i].copy() for i in range(4)}})

    return run


INDEX = "token long, key long, n int, pos int, own int, b0 long, b1 long, b2 long, b3 long"


def joined(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.frombuffer(p[name], kind) for p in parts]) for name, kind in (("hashes", np.uint64), ("times", np.uint16)))


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes to (key, n, part, hashes): the shared shingles cut into ``PARTS`` ranges of the order."""
    for batch in lean(batches):
        rows = []
        for key, n, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x = np.sort(joined(parts)[0])
            edges = np.searchsorted(fragment_of(x, PARTS), np.arange(PARTS + 1, dtype=np.uint64))
            rows += [(key, n, p, x[edges[p] : edges[p + 1]].view(np.int64)) for p in range(PARTS) if edges[p] < edges[p + 1]]
        if rows:
            k, n, p, h = zip(*rows)
            yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.int64()), "n": pa.array(n, pa.int32()), "part": pa.array(p, pa.int32()), "hashes": pa.array(h, pa.list_(pa.int64()))})


MEMBER = ("key", "comp", "n", "pos", "own", "b0", "b1", "b2", "b3")


def may_link(percent: int, a: str, b: str) -> Column:
    """Bounds on two index rows of one list: lengths, positions in the order, parity bits."""
    x = lambda side, c: F.col(f"{side}.{c}").cast("long")
    na, nb = x(a, "n"), x(b, "n")
    lengths = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    # overlap >= t / (1 + t) * (na + nb), and all of it lies from this shingle on
    places = (100 + percent) * (1 + F.least(na - x(a, "pos"), nb - x(b, "pos")) - 1) >= percent * (na + nb)
    # differing shingles: those of one class alone, and at least the differing bits
    bits = [F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(4)]
    apart = x(a, "own") + x(b, "own") + bits[0] + bits[1] + bits[2] + bits[3]
    near = (100 + percent) * apart <= (100 - percent) * (na + nb)
    return (F.col(f"{a}.comp") != F.col(f"{b}.comp")) & lengths & places & near


def pairs_of(rows: DataFrame, a: str, b: str) -> DataFrame:
    low, high = F.least(f"{a}.key", f"{b}.key"), F.greatest(f"{a}.key", f"{b}.key")
    return rows.select(low.alias("a"), high.alias("b")).distinct()


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold: partial overlaps a fragment, summed per pair."""
    left = parts.select(F.col("key").alias("a"), "part", F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = parts.select(F.col("key").alias("b"), "part", F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, ["b", "part"])
    sums = both.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("ha", "hb"))).alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return sums.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that is not a root itself: the smallest node it reaches.

    Large-star and small-star steps by grouping and joining, until a step changes nothing.
    """
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "jaccard-edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        e = stored(large.join(low, "u").select(moved.alias("x")).select("x.*").where("u != v").distinct(), "jaccard-edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def components(index: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(key, comp) of every indexed class; classes of one component have one comp."""
    comp = stored(index.select("key").distinct().withColumn("comp", F.col("key")), "jaccard-components")
    member = F.struct(*MEMBER)
    turn = 0
    while True:
        last = turn >= ROUNDS
        live = index.join(comp, "key").select("token", *MEMBER)
        lists = live.groupBy("token")
        ends = [F.min("comp").alias("lo"), F.max("comp").alias("hi")]
        if last:
            open_ = lists.agg(*ends).where("lo != hi").select("token")
            rows = live.join(open_, "token").select("token", member.alias("x"))
            other = rows.select(F.col("token").alias("t"), F.col("x").alias("s"))
            met = rows.join(other, (F.col("token") == F.col("t")) & (F.col("x.key") < F.col("s.key")) & may_link(percent, "x", "s"))
        else:
            # the class with the fewest shingles of its own is likely what the others were copied from
            stars = [] if turn else [F.min(F.struct((F.col("own") / F.col("n")).alias("o"), F.col("key").alias("k"), member.alias("m")))["m"]]
            stars += [F.min(F.struct(F.xxhash64("key", F.lit(turn * STARS + i)).alias("h"), member.alias("m")))["m"] for i in range(len(stars), STARS)]
            chosen = lists.agg(*ends, F.array(*stars).alias("stars")).where("lo != hi").select(F.col("token").alias("t"), F.explode(F.array_distinct("stars")).alias("s"))
            rows = live.select("token", member.alias("x"))
            met = rows.join(chosen, (F.col("token") == F.col("t")) & may_link(percent, "x", "s"))
        tests = stored(met.select(F.least("x.key", "s.key").alias("a"), F.greatest("x.key", "s.key").alias("b")).distinct(), "jaccard-pairs")
        links = stored(linked(tests, parts, percent), "jaccard-links")
        n_tests, n_links = tests.count(), links.count()
        if n_links:
            a, b = (comp.select(F.col("key").alias(s), F.col("comp").alias(f"c{s}")) for s in "ab")
            roots = contracted(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            comp = stored(comp.join(roots, comp.comp == roots.node, "left").select("key", F.coalesce("root", "comp").alias("comp")), "jaccard-components")
        if last:
            return comp
        # a turn that linked little is the last one with stars
        turn = turn + 1 if n_links > WORTH * n_tests else ROUNDS


def keyed(text: Column) -> Column:
    """The class key of each text, null for one without words. A filter on it does not work it out a second
    time, in a second Python worker, which Spark does with a function that it takes for deterministic."""

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lean(texts):
            yield pd.Series([class_key(words) if (words := words_of(t)) else None for t in part], dtype="Int64")

    return run.asNondeterministic()(text)


def join_documents(docs: DataFrame, size: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_key, component_id, component_key) of every row. The key is of one
    component alone; the id, its smallest, may be that of several where documents share an id."""
    seen = stored(docs.select(F.col(key).alias("doc_id"), described(F.col(text), size).alias("x")).select("doc_id", "x.*"), "jaccard-classes")
    total = seen.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    fragments = max(FRAGMENTS, -(-(total["n"] or 0) // FRAGMENT))
    # a bounded list: what counts lies in OFTEN / 2 of all documents, so there are at most 2 / OFTEN
    # times as many as a mean document has shingles
    often = seen.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("o")).select("o.*")
    often = often.groupBy("often").agg(F.sum("times").alias("t")).where(F.col("t") >= max(16.0, total["rows"] * OFTEN / 2)).select("often")
    often = np.sort(np.array([r["often"] for r in often.collect()], np.int64).view(np.uint64))

    cuts = docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(cut(size, fragments, often), "frag int, keys binary, sizes binary, counts binary, hashes binary")
    counted = cuts.groupBy("frag").applyInArrow(shared, "key long, n int, s int, hashes binary, times binary")
    whole = counted.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("hashes", "times")).alias("parts"), F.sum("s").alias("s"))
    # a class whose shared shingles are too few for any partner leaves
    left = stored(whole.where(100 * F.col("s") >= percent * F.col("n")).select("key", "n", "parts"), "jaccard-shared")
    index = stored(left.mapInArrow(indexed(percent), INDEX), "jaccard-index")
    parts = stored(left.mapInArrow(segments, "key long, n int, part int, hashes array<long>"), "jaccard-parts")
    comp = components(index, parts, percent)

    classes = seen.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("first_id"))
    linked_ = comp.join(classes, "key")
    roots = linked_.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = classes.join(linked_.join(roots, "comp").select("key", "component_id", "comp"), "key", "left")
    named = named.select(F.col("key").alias("class_key"), F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("comp", "key").alias("component_key"))
    out = seen.join(named, seen.key == named.class_key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.coalesce("component_id", "doc_id").alias("component_id"), "component_key")
