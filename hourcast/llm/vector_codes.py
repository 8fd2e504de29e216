"""Operator 11: vector codes by product quantisation, entries found by slice-and-intersect bitmasks.

A vector is cut into equal parts, and each part position has a codebook of at
most 64 entries. Per dimension the entries' coordinates are sorted and carry
prefix masks: mask i holds the bits of the first i entries in that order. A part
takes the distance to one entry as its radius; two binary searches per dimension
cut the slice of entries within it, the slice's mask is the difference of two
prefix masks, and the masks of all dimensions are ANDed into one uint64. No entry
at that distance or nearer lies outside of the mask, so the nearest entry of the
mask is the nearest of all, ties included.

Codebooks are trained by rounds of assignment and integer means. A round is one
scan of the table; tasks send sums of codebook size, never rows.

Cases: vectors that are null, or hold null, NaN or infinite components, take no
part; rows without an id are coded, and come last in the order that starts the
codebooks; rows that repeat an id are coded each, in the order of their vectors;
vectors of other lengths are padded with zeros to the longest, rounded up to whole
parts; with fewer rows than entries a codebook has as many entries as rows; ties go
to the lower entry; an empty table gives no rows; other columns are not looked at.
A component whose squared distances could leave 64 bits raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import stored
from hourcast.llm.topk import usable

#: A label on at least one in so many rows is joined by broadcast: there are at most so many of them.
HOT = 256


class Codebook:
    """The entries of one part position, with sorted coordinates and prefix masks per dimension."""

    def __init__(self, entries: np.ndarray):
        if not 1 <= len(entries) <= 64:
            raise ValueError("a codebook has 1 to 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[order[:, d], d].copy() for d in range(entries.shape[1])]
        bits = np.uint64(1) << order.astype(np.uint64)
        self.prefix = [np.append(np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[:, d])) for d in range(entries.shape[1])]
        self.order = order
        spread = [int(s[-1]) - int(s[0]) for s in self.sorted]
        self.widest = int(np.argmax(spread)) if spread else 0

    def masks(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Entries within ``radius`` of each row of ``x`` in every dimension, as uint64 masks."""
        out = np.full(len(x), np.uint64((1 << len(self.entries)) - 1))
        for d, (coords, prefix) in enumerate(zip(self.sorted, self.prefix)):
            lo = np.searchsorted(coords, x[:, d] - radius, "left")
            hi = np.searchsorted(coords, x[:, d] + radius, "right")
            out &= prefix[hi] & ~prefix[lo]
        return out

    def probe(self, x: np.ndarray) -> np.ndarray:
        """The entry whose coordinate in the widest dimension is beside the row's."""
        d = self.widest
        at = np.minimum(np.searchsorted(self.sorted[d], x[:, d]), len(self.entries) - 1)
        return self.order[at, d]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each row, ties to the lower entry."""
        if not len(x) or not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        first = ((x - self.entries[self.probe(x)]) ** 2).sum(axis=1)
        radius = np.floor(np.sqrt(first.astype(float))).astype(np.int64) + 1
        mask = self.masks(x, radius)
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)  # by row, then by entry; every row has its probe at least
        far = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        begin = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(far, begin)
        hit = np.flatnonzero(far == least[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], least


def matrix(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """Scaled and floored components, a row each, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    flat = np.floor(float(scale) * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    limit = float(np.sqrt(2.0**60 / max(1, width)))  # four times this squared, over a whole vector, stays below 2^62
    if len(flat) and max(flat.max(), -flat.min()) > limit:
        raise ValueError(f"a component beyond {limit:.0f} after scaling: squared distances would leave 64 bits")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) arrays of the nearest entries and their squared distances."""
    step = x.shape[1] // len(books)
    found = [Codebook(b).nearest(x[:, p * step : (p + 1) * step]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def sums(books: list[np.ndarray], scale: int):
    """Per task: (part, entry, dimension, sum, count) of the parts assigned to every entry."""
    step, size = books[0].shape[1], len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), size, step), np.int64)
        count = np.zeros((len(books), size), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), scale, step * len(books))
            entry, _ = assigned(x, books)
            for p in range(len(books)):
                np.add.at(total[p], entry[:, p], x[:, p * step : (p + 1) * step])
                count[p] += np.bincount(entry[:, p], minlength=size)
        p, e = np.nonzero(count)
        if len(p):
            d = np.tile(np.arange(step), len(p))
            yield pa.RecordBatch.from_pydict({
                "part": np.repeat(p, step), "entry": np.repeat(e, step), "d": d,
                "total": total[p, e].ravel(), "n": np.repeat(count[p, e], step)})

    return run


def trained(vectors: DataFrame, vector: str, key: str, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """Codebooks by part position, entries x step each; empty without rows. The driver sees ``entries``
    vectors to start with and one codebook a round."""
    first = vectors.orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).select(vector).toArrow().column(0)
    longest = vectors.agg(F.max(F.size(vector))).first()[0]
    if longest is None:
        return []
    step = -(-longest // parts) or 1
    start = matrix(first, scale, step * parts)
    books = [start[:, p * step : (p + 1) * step].copy() for p in range(parts)]
    for _ in range(rounds):
        told = vectors.select(vector).mapInArrow(sums(books, scale), "part long, entry long, d long, total long, n long")
        # sums of many tasks may pass 64 bits
        told = told.groupBy("part", "entry", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in told.collect():
            books[r["part"]][r["entry"], r["d"]] = int(r["total"]) // r["n"]
    return books


def coder(books: list[np.ndarray], scale: int):
    width = books[0].shape[1] * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = assigned(matrix(batch.column(2), scale, width), books)
            code = [row.tobytes() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.binary()), pa.array(far.sum(axis=1))], ["vec_id", "label", "entries", "error"])

    return run


def listed_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def with_totals(rows: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal keys, nulls together. Keys on many rows, at most
    ``HOT`` of them, are joined by broadcast and so never meet in one task; the others by a shuffle."""
    totals = rows.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias(to), F.count("*").alias("_n"))
    n = rows.count()
    hot = F.broadcast(totals.where(F.col("_n") * HOT >= n).select(F.col("_k"), F.col(to), F.lit(True).alias("_hot")))
    met = rows.join(hot, F.col(key).eqNullSafe(F.col("_k")), "left")
    often = met.where("_hot").drop("_k", "_hot")
    cold = totals.where(F.col("_n") * HOT < n).select("_k", to)
    rest = met.where("_hot is null").drop("_k", "_hot", to).join(cold, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    return often.unionByName(rest)


def coded(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
          key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, entries, error) of every usable row, codebooks): ``entries`` holds a byte per part."""
    kept = vectors.where(usable(F.col(vector))).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    books = trained(kept, "v", "vec_id", parts, entries, rounds, scale)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, entries binary, error long"
    if not books:
        return vectors.sparkSession.createDataFrame([], schema), books
    return kept.mapInArrow(coder(books, scale), schema), books


def code_vectors(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    rows, books = coded(vectors, **options)
    rows = stored(rows.select("vec_id", "label", F.lower(F.hex("entries")).alias("code"), "error"), "codes")
    out = with_totals(rows, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(listed_hash(books)).alias("codebooks_sha256"))
