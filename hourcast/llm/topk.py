"""Operator 5: exact top-k inner-product search with pivot-table elimination.

Every vector has its distances to a table of pivots. For a query q and a
candidate v the largest gap |d(q,p) - d(v,p)| over the pivots bounds d(q,v)
from below, and so the inner product (|q|^2 + |v|^2 - d^2) / 2 from above.
Candidates lie in tiles of rows at similar distances from their nearest pivot; a
tile's bound holds for all of it. Tiles are scored in the order of that bound, each
for the queries whose k-th best score it can still reach, which makes the result
exact. Scores are products of matrices, in the smallest numbers that hold them exactly.

Rows lie in shards of about ``SHARD`` vectors and queries in blocks of about
``BLOCK`` (of 64 components; fewer wider ones), packed in the smallest integers that
hold them; a block meets a shard once, gives its k best there, and a window
limited to k rows per query merges the shards. Memory per task is one shard and
one block, whatever the table's size; nothing but the pivots and counts comes to the driver.

Cases: vectors that are null, or hold null, NaN or infinite components, and rows
without an id take no part; rows that repeat an id are queries and candidates each,
and only a query's own row is left out; vectors of other lengths are padded with
zeros; ties go to the smaller id; an empty table, or one without queries, gives no
rows; columns beyond id and vector are not looked at. A component whose products
could leave 64 bits raises an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import give_back, stored

SHARD, BLOCK, PIVOTS = 131_072, 65_536, 32
#: Shards of a small table, as far as each has ``LEAST`` rows: its tasks.
SHARDS, LEAST = 64, 1024
#: Queries and candidates that are scored at once.
ROWS, TILE = 512, 2048


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~odd


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of the lists, padded with zeros, in the smallest integers that hold them."""
    parts, sizes = [], [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.chunks]
    width = max(1, *(int(n.max(initial=0)) for n in sizes))
    limit = int(np.sqrt(2.0**61 / width))
    for chunk, n in zip(lists.chunks, sizes):
        x = chunk.flatten().to_numpy()
        low, high = int(x.min(initial=0)), int(x.max(initial=0))
        if max(high, -low) > limit:
            raise ValueError(f"a component beyond {limit} after scaling: products would leave 64 bits")
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        if (n == width).all():
            parts.append(x.astype(kind).reshape(-1, width))
        else:
            part = np.zeros((len(n), width), kind)
            part[np.arange(width) < n[:, None]] = x
            parts.append(part)
    return np.concatenate(parts)


def packed(rows: DataFrame, group: str) -> DataFrame:
    """One row per group: ids, row numbers and vectors as bytes, with the bytes of a component."""
    def pack(table: pa.Table) -> pa.Table:
        v = matrix(table["v"])
        numbers = [table[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "row_no")]
        give_back()
        return pa.table({"grp": [table[group][0].as_py()], "ids": [numbers[0]], "rows": [numbers[1]], "vectors": [v.tobytes()], "item": [v.itemsize]})

    return rows.select(group, "vec_id", "row_no", "v").groupBy(group).applyInArrow(pack, "grp long, ids binary, rows binary, vectors binary, item long")


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(v), len(pivots)))
    own = (pivots * pivots).sum(1)
    for i in range(0, len(v), TILE):
        f = v[i : i + TILE].astype(float)
        out[i : i + TILE] = np.sqrt(np.maximum((f * f).sum(1)[:, None] + own - 2 * f @ pivots.T, 0))
    return out


def tiled(far: np.ndarray) -> np.ndarray:
    """An order of rows in which neighbours lie near one pivot, at similar distances."""
    if not far.shape[1]:
        return np.arange(len(far))
    near = far.argmin(1)
    return np.lexsort((far[np.arange(len(far)), near], near))


def squares(v: np.ndarray) -> np.ndarray:
    return np.concatenate([(f * f).sum(1) for i in range(0, len(v), TILE) for f in [v[i : i + TILE].astype(float)]])


def merged(k: int, of: np.ndarray, to: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best of every query, by score, id and row: places, and which of its best each one is."""
    order = np.lexsort((rows[to], ids[to], -score, of))
    of, to, score = of[order], to[order], score[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    nth = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    top = nth < k
    return of[top], to[top], score[top], nth[top]


def best(k: int, q: np.ndarray, v: np.ndarray, q_far: np.ndarray, v_far: np.ndarray, v_ids: np.ndarray, q_rows: np.ndarray, v_rows: np.ndarray) -> np.ndarray:
    """Rows (query, candidate, score) of the k best candidates of every query, as places in the arrays."""
    q_sq, v_sq = squares(q), squares(v)
    # no sum on the way to a product is larger than the product of the lengths
    most = np.sqrt(q_sq.max(initial=0)) * np.sqrt(v_sq.max(initial=0)) * (1 + 1e-9)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64
    none = np.iinfo(kind).min if kind is np.int64 else -np.inf
    order, asked = tiled(v_far), tiled(q_far)
    tiles = [order[i : i + TILE] for i in range(0, len(v), TILE)]
    low, high = (np.array([f(v_far[t], axis=0) for t in tiles]) for f in (np.min, np.max))
    long_ = np.array([v_sq[t].max() for t in tiles])
    del v_far
    ids, rows, small, v = v_ids[order], v_rows[order], v, np.empty(v.shape, kind)
    for i, t in enumerate(tiles):
        v[i * TILE : i * TILE + len(t)] = small[t]
    out = []
    for i in range(0, len(q), ROWS):
        at = asked[i : i + ROWS]
        part, own = q[at].astype(kind), q_rows[at]
        gap = np.zeros((len(at), len(low)))
        for p in range(q_far.shape[1]):
            d = q_far[at, p][:, None]
            np.maximum(gap, np.maximum(low[:, p] - d, d - high[:, p]), out=gap)
        # distances carry rounding of about 1e-8 of a length: the bound gives that much away, and more
        both = q_sq[at][:, None] + long_
        bound = (both - np.maximum(gap - 1e-6 * (1 + gap), 0) ** 2) / 2 + 1e-6 * both + 1e-6
        least, last_id = np.full(len(at), none, kind), np.full(len(at), np.iinfo(np.int64).max)  # the k-th best so far
        of, to, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        for t in np.argsort(-bound.max(0), kind="stable"):
            open_ = np.flatnonzero(bound[:, t] >= least)
            if not len(open_):
                continue
            start = t * TILE
            s = (part if len(open_) == len(part) else part[open_]) @ v[start : start + TILE].T
            hit = np.flatnonzero(s.max(1) >= least[open_])
            if not len(hit):
                continue
            s, open_ = s[hit], open_[hit]
            reach = least[open_]
            if s.shape[1] > k + 1:  # a query's own row may be among the k + 1 best
                reach = np.maximum(reach, np.partition(s, -k - 1, axis=1)[:, -k - 1])
            a, b = np.nonzero(s >= reach[:, None])
            who, c, x = open_[a], start + b, s[a, b]
            fit = (rows[c] != own[who]) & ((x > least[who]) | (ids[c] <= last_id[who]))
            if fit.any():
                who, c, x = who[fit], c[fit], x[fit]
                touched = np.zeros(len(at), bool)
                touched[who] = True
                old = touched[of]
                new = merged(k, np.append(of[old], who), np.append(to[old], c), np.append(score[old], x), ids, rows)
                of, to, score = (np.append(x[~old], y) for x, y in zip((of, to, score), new))
                end = new[3] == k - 1
                least[new[0][end]], last_id[new[0][end]] = new[2][end], ids[new[1][end]]
        out.append(np.stack([at[of], order[to], score.astype(np.int64)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


FOUND = ("query_id", "query_row", "vec_id", "vec_row", "score")


def meet(k: int, pivots: list[list[int]]):
    """A block of queries and a shard: the k best of the shard for every query."""
    def run(table: pa.Table) -> pa.Table:
        x = {name: table[name][0] for name in table.schema.names}
        q_ids, q_rows, ids, rows = (np.frombuffer(x[n].as_buffer(), np.int64) for n in ("q_ids", "q_rows", "ids", "rows"))
        q, v = (np.frombuffer(x[n].as_buffer(), f"i{x[item].as_py()}").reshape(n_rows, -1) for n, item, n_rows in (("q_vectors", "q_item", len(q_ids)), ("vectors", "item", len(ids))))
        width = max(q.shape[1], v.shape[1], *map(len, pivots))
        q, v = (m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
        p = np.zeros((len(pivots), width))
        for r, w in enumerate(pivots):
            p[r, : len(w)] = w
        of, to, score = best(k, q, v, distances(q, p), distances(v, p), ids, q_rows, rows).T
        told = (q_ids[of], q_rows[of], ids[to], rows[to], score)
        give_back()
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in told], list(FOUND))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of every query row; ``is_query`` is said of ``vec_id``."""
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("v"))
    # the row number is stored with the row: it tells rows of one id apart from here on
    rows = stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "topk-rows")
    count = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("width")).first()
    wide = max(1, (count["width"] or 0) / 64)
    shards = max(math.ceil(count["n"] * wide / SHARD), min(SHARDS, -(-count["n"] // LEAST)), 1)
    blocks = max(math.ceil(count["q"] * wide / BLOCK), 1)
    # PIVOTS rows by hash order: a bounded table that goes to every task
    pivots = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOTS).collect()]
    sharded = packed(rows.withColumn("s", F.pmod(F.xxhash64("vec_id", "row_no"), F.lit(shards))), "s")
    asked = packed(rows.where(is_query).withColumn("b", F.pmod(F.xxhash64("vec_id", "row_no", F.lit(7)), F.lit(blocks))), "b")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))
    asked = asked.select(F.col("grp").alias("block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "vectors", "item")), every.alias("grp"))
    # a group is one block and one shard: what a task holds at a time does not depend on how many there are
    near = asked.join(sharded, "grp").groupBy("grp", "block").applyInArrow(meet(k, pivots), ", ".join(f"{c} long" for c in FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
