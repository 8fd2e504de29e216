"""Operator 13: removal of repeated byte strings by suffix arrays.

Every byte covered by a ``length``-byte string that also starts anywhere else goes.

Which shard holds what. Each ``length``-byte window is named by the smallest hash of
the short strings in it, so equal windows have equal names, whatever document they
lie in. Runs of windows of one name are segments. A name that occurs once in the
corpus cannot hold a repeat; the segments of all other names are dealt out by name,
and equal segments of a shard of texts enter once with their number.

What a shard does. It sorts the suffixes of its segments by Larsson-Sadakane
refinement (only groups still tied are sorted again, by the rank ``h`` places on, ``h``
doubling), finds common prefixes by Kasai's walk, many stretches of text at a time,
and reads off the windows that occur twice or more.

What crosses shards. A name on very many segments is dealt to several shards. Windows
they hold once are merged between them: every shard sends them as sorted arrays, cut by
range, and pairs of arrays are merged by binary search until one is left.

Cases: null texts count as empty; texts shorter than ``length`` stay as they are;
repeated rows, ids included, are texts each, so copies of a long text lose all; matches
never cross documents; very long texts are read whole, in overlapping stretches; an
empty table gives no rows; columns beyond id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import stored

#: Bytes of text in a shard of texts, and of segments in a suffix array, about.
SHARD, BUCKET = 2 << 20, 1 << 20
#: Places of a name in one suffix array at most; beyond it the name is dealt to several.
HOT = 4096
#: Places of text whose hashes are worked on together; few enough that they stay near the processor.
STRETCH = 1 << 17
#: Rows of shards in a partition.
TOGETHER = 16
#: Symbols in the first key of the suffix sort: nine bits each, 0 for the end.
WIDE = 7

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)


def short_length(length: int) -> int:
    """Length of the strings that name windows: a power of two, about a sixth of a window."""
    return 1 << max(0, (length // 4).bit_length() - 1)


def runs(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, name) of the runs of windows with one name; ``ends`` are those of the documents in ``text``."""
    begins = np.append(0, ends[:-1])
    long = ends - begins >= length
    inside = np.zeros(len(text) + 1, np.int8)
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
    found = [stretch_runs(text[at : at + STRETCH + length - 1], inside[at : at + STRETCH], length, at) for at in range(0, max(0, len(text) - length + 1), STRETCH)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def stretch_runs(text: np.ndarray, inside: np.ndarray, length: int, offset: int):
    k = short_length(length)
    h, base, step = LETTER[text], int(ODD), 1
    while step < k:
        h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    name = mixed(h)
    # the upper bits of a name and its place: the smallest is the first of the smallest
    low = (name & ~np.uint64((1 << 24) - 1)) | np.arange(len(name), dtype=np.uint64)
    width, step = length - k + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: -(width - step)], low[width - step :])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = inside[: len(at)]
    new = np.append(True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    keep = inside[begin]
    begin, size = begin[keep], size[keep]
    return begin + offset, size, name[at[begin]]


# suffix arrays

def packed_symbols(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ends, begins): the next ``WIDE`` symbols at every place of the segments, laid out with room
    between them, the end of the segment at every place, and the segments' first places."""
    sizes = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(sizes + WIDE) - sizes - WIDE
    text = np.frombuffer((b"\0" * WIDE).join([*segments, b""]), np.uint8)
    ends = np.repeat(begins + sizes, sizes + WIDE)
    place = np.arange(len(text))
    symbols = np.where(place < ends, text.astype(np.uint64) + np.uint64(1), np.uint64(0))
    one = np.append(symbols, np.zeros(WIDE, np.uint64))
    two = one[:-1] << np.uint64(9) | one[1:]
    four = two[:-2] << np.uint64(18) | two[2:]
    n = len(text)
    keys = (four[:n] << np.uint64(9) | one[4 : n + 4]) << np.uint64(18) | two[5 : n + 5]
    return keys, ends, begins


def suffix_array(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes; equal suffixes by place."""
    n = len(keys)
    left = (ends - np.arange(n)).astype(np.int32)
    places = np.flatnonzero(left > 0).astype(np.int32)
    by = np.argsort(keys[places])
    order = places[by]
    rank = np.zeros(n, np.int32)
    slots, idx, key, h = np.arange(len(order), dtype=np.int32), order, keys[order], WIDE
    equal = []
    while len(idx):
        new = np.append(True, key[1:] != key[:-1])
        now = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        rank[idx] = now
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        slots, idx, now = slots[tied], idx[tied], now[tied]
        # suffixes that have ended before and are still tied are the same
        on = left[idx] >= h
        done = np.flatnonzero(~on)
        equal.append((slots[done], idx[done], now[done]))
        on = np.flatnonzero(on)
        slots, idx, now = slots[on], idx[on], now[on]
        key = now.astype(np.int64) << 32 | rank[idx + h]
        by = np.argsort(key)
        idx, key = idx[by], key[by]
        order[slots] = idx
        h *= 2
    for slots, idx, now in equal:
        order[slots] = idx[np.argsort(now.astype(np.int64) << 32 | idx)]
    return order


def common_prefixes(keys: np.ndarray, ends: np.ndarray, order: np.ndarray, begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in ``order``: Kasai's walk along
    all segments together, over the first ``count`` places of each; elsewhere 0."""
    n = len(keys)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    left = (ends - np.arange(n)).astype(np.int32)
    out = np.zeros(n, np.int32)
    by = np.argsort(-count, kind="stable")  # segments that are at their end leave from behind
    base, count = begins[by], count[by]
    h = np.zeros(len(base), np.int64)
    for t in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-count, -t, "left"))
        p = base[:live] + t
        q = before[p]
        there = q >= 0
        h[:live][~there] = 0
        lane = np.flatnonzero(there)
        p, q = p[lane], q[lane]
        most = np.minimum(left[p], left[q])
        now = np.minimum(np.maximum(h[lane] - 1, 0), most)
        go = np.flatnonzero(now < most)
        while len(go):
            x = keys[p[go] + now[go]] ^ keys[q[go] + now[go]]
            # equal symbols before the first bit that differs
            bits = np.frexp((x >> np.uint64(9)).astype(float))[1]
            now[go] = np.minimum(now[go] + np.where(x == 0, WIDE, WIDE - 1 - (bits + 8) // 9), most[go])
            go = go[(x == 0) & (now[go] < most[go])]
        out[p] = now
        h[lane] = now
    return out[order]


def repeated(segments: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, group) of every window in the order of suffixes, and how many copies each group has."""
    keys, ends, begins = packed_symbols(segments)
    order = suffix_array(keys, ends)
    # shorter suffixes than a window share less than one
    prefix = common_prefixes(keys, ends, order, begins, np.maximum(ends[begins] - begins - length + 1, 0))
    group = np.cumsum(prefix < length)
    window = ends[order] - order >= length
    place, group = order[window], group[window]
    segment = np.searchsorted(begins, place, "right") - 1
    _, group = np.unique(group, return_inverse=True)
    return segment, place - begins[segment], group, np.bincount(group, weights=copies[segment]).astype(np.int64)


def spans_of(offsets: np.ndarray) -> list[int]:
    """Ascending numbers as begin, end, begin, end, ..."""
    cut = np.flatnonzero(np.diff(offsets) != 1)
    return np.stack([offsets[np.append(0, cut + 1)], offsets[np.append(cut, len(offsets) - 1)] + 1], axis=1).ravel().tolist()


# stages

def shards_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(shard, keys, sizes, body): texts as bytes, about ``SHARD`` of them a row, compressed."""
    kind = docs.schema[key].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            body = pa.Codec("zstd", 3).compress(b"".join(texts), asbytes=True)
            shard = pa.array([part << 18 | number], pa.int64())
            return pa.RecordBatch.from_arrays([shard, pa.array([keys], pa.list_(keyed)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([body], pa.binary())], ["shard", "keys", "sizes", "body"])

        for batch in batches:
            keyed = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                keys.append(k)
                texts.append(raw)
                size += len(raw)
                if size >= SHARD or len(texts) >= 10_000:
                    yield row()
                    number, keys, texts, size = number + 1, [], [], 0
        if texts:
            yield row()

    return docs.select(key, text).mapInArrow(pack, f"shard long, keys array<{kind.simpleString()}>, sizes array<long>, body binary")


def opened(sizes: pa.Scalar, body: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(text, document ends) of a shard."""
    ends = np.cumsum(sizes.values.to_numpy(zero_copy_only=False).astype(np.int64))
    total = int(ends[-1]) if len(ends) else 0
    text = pa.Codec("zstd").decompress(body.as_buffer(), total, asbytes=True) if total else b""
    return np.frombuffer(text, np.uint8), ends


def names(length: int):
    """(name, shard, n): how often each name names a run of the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, name = runs(*opened(batch["sizes"][i], batch["body"][i]), length)
                name, n = np.unique(name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.full(len(n), batch["shard"][i].as_py())), pa.array(n)], ["name", "shard", "n"])

    return run


def segments(length: int):
    """(shard, first, name, total, copies, segment) of the different segments whose names occur again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, ends = opened(batch["sizes"][i], batch["body"][i])
                begin, size, name = runs(text, ends, length)
                listed = batch["found"][i].values
                wanted, total = (listed.field(j).to_numpy().astype(np.int64) for j in (0, 1))
                order = np.argsort(wanted)
                wanted, total = wanted[order], total[order]
                at = np.searchsorted(wanted, name.view(np.int64))
                hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == name.view(np.int64))
                raw, seen = text.tobytes(), {}
                for r, b, e in zip(hit.tolist(), begin[hit].tolist(), (begin[hit] + size[hit] + length - 1).tolist()):
                    seen.setdefault(raw[b:e], [b, r, 0])[2] += 1
                rows = list(seen.values())
                first, row, copies = (np.array([x[j] for x in rows], np.int64) for j in range(3))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), batch["shard"][i].as_py())), pa.array(first), pa.array(name[row].view(np.int64)), pa.array(total[at[row]]),
                    pa.array(copies), pa.array(list(seen), pa.binary())], ["shard", "first", "name", "total", "copies", "segment"])

    return run


MARKS = "shard long, first long, spans array<long>, name long, part long, windows binary, owners binary"
KINDS = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("spans", pa.list_(pa.int64())), ("name", pa.int64()), ("part", pa.int64()), ("windows", pa.binary()), ("owners", pa.binary())])


def marks(length: int):
    """What one suffix array finds: spans of repeated window starts in segments, and for names dealt to
    several arrays the windows that others may repeat: sorted digests with (shard, first, offset), or -1
    where the repeat is found already."""
    def run(table: pa.Table) -> pa.Table:
        owner = [table[c].to_numpy() for c in ("shard", "first", "name", "total", "copies", "deals")]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(s, len(number)) for s in table["segment"].to_pylist()], np.int64)
        copies = np.bincount(which, weights=owner[4], minlength=len(number)).astype(np.int64)
        texts = list(number)
        segment, offset, group, size = repeated(texts, copies, length)
        often = size[group] > 1
        out = {c: [] for c in KINDS.names}

        def put(**row):
            for c in KINDS.names:
                out[c].append(row.get(c))

        by = np.lexsort((offset[often], segment[often]))
        seg, off = segment[often][by], offset[often][by]
        lo, hi = np.searchsorted(seg, np.arange(len(texts))), np.searchsorted(seg, np.arange(len(texts)), "right")
        for r, s in enumerate(which.tolist()):
            if hi[s] > lo[s]:
                put(shard=int(owner[0][r]), first=int(owner[1][r]), spans=spans_of(off[lo[s] : hi[s]]))
        row_of = np.full(len(texts), -1, np.int64)
        row_of[which] = np.arange(len(which))
        hot = np.flatnonzero(owner[5][row_of[segment]] > 1) if len(texts) else np.zeros(0, np.int64)
        # one window of each group, in the order of digests
        hot = hot[np.unique(group[hot], return_index=True)[1]]
        digest = np.array([hashlib.blake2b(texts[s][o : o + length], digest_size=16).digest() for s, o in zip(segment[hot].tolist(), offset[hot].tolist())], "S16")
        rows = row_of[segment[hot]]
        deals, name = owner[5][rows], owner[2][rows]
        part = np.array([int.from_bytes(d[:4].ljust(4, b"\0"), "big") for d in digest], np.int64) * deals >> 32
        owners = np.stack([owner[0][rows], owner[1][rows], offset[hot]], axis=1)
        owners[often[hot]] = -1
        by = np.lexsort((digest, part, name))
        cut = np.flatnonzero(np.append(True, np.any([np.diff(x[by]) != 0 for x in (name, part)], axis=0))) if len(by) else []
        for b, e in zip(cut, np.append(cut[1:], len(by))):
            take = by[b:e]
            put(name=int(name[take[0]]), part=int(part[take[0]]), windows=digest[take].tobytes(), owners=owners[take].astype("<i8").tobytes())
        return pa.Table.from_pydict(out, KINDS)

    return run


def merged(a: tuple, b: tuple) -> tuple:
    """Two sorted arrays (digests, owners, seen elsewhere) as one: the places of one in the other by binary search."""
    at = np.searchsorted(a[0], b[0])
    same = np.zeros(len(b[0]), bool)
    there = at < len(a[0])
    same[there] = a[0][at[there]] == b[0][there]
    a[2][at[same]] = True
    b[2][same] = True
    # equal windows stay beside each other, each with its own owner
    return tuple(np.insert(x, at, y, axis=0) for x, y in zip(a, b))


def meet(table: pa.Table) -> pa.Table:
    """Windows of one name and range from several suffix arrays: spans of those that two or more hold."""
    arrays = []
    for w, o in zip(table["windows"].to_pylist(), table["owners"].to_pylist()):
        arrays.append((np.frombuffer(w, "S16"), np.frombuffer(o, "<i8").reshape(-1, 3), np.zeros(len(w) // 16, bool)))
    while len(arrays) > 1:
        arrays = [merged(*arrays[i : i + 2]) if i + 1 < len(arrays) else arrays[i] for i in range(0, len(arrays), 2)]
    digest, owner, seen = arrays[0]
    # a mark reaches all equal windows
    new = np.append(True, digest[1:] != digest[:-1])
    seen = np.logical_or.reduceat(seen, np.flatnonzero(new))[np.cumsum(new) - 1]
    owner = owner[seen & (owner[:, 0] >= 0)]
    owner = owner[np.lexsort(owner.T[::-1])]
    cut = np.flatnonzero(np.append(True, np.any(owner[1:, :2] != owner[:-1, :2], axis=1))) if len(owner) else np.zeros(0, np.int64)
    rows = [(int(owner[b, 0]), int(owner[b, 1]), spans_of(owner[b:e, 2])) for b, e in zip(cut, np.append(cut[1:], len(owner)))]
    return pa.Table.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["shard", "first", "spans"])


def cut_out(length: int):
    """The documents of a shard without what its marks cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, ends = opened(batch["sizes"][i], batch["body"][i])
                start = np.zeros(len(text) + 1, bool)
                if batch["found"][i].is_valid:
                    mark(start, text, ends, batch["found"][i].values, length)
                count = np.cumsum(np.append(np.zeros(length, np.int64), start[:-1]))
                gone = count[length:] - count[:-length] > 0
                yield pa.RecordBatch.from_arrays([*documents(batch["keys"][i].values, text, ends, gone)], ["key", "n_bytes", "spans", "kept"])

    return run


def mark(start: np.ndarray, text: np.ndarray, ends: np.ndarray, found: pa.Array, length: int) -> None:
    """Set the starts of repeated windows: of the segments named in ``found``, and of all equal to them."""
    begin, size, name = runs(text, ends, length)
    listed = {}
    for first, spans in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
        listed.setdefault(first, []).extend(spans)
    at = np.searchsorted(begin, np.array(list(listed), np.int64))
    hit = np.flatnonzero(np.isin(name, name[at]))
    raw = text.tobytes()
    by = {raw[b : b + s + length - 1]: listed[b] for b, s in zip(begin[at].tolist(), size[at].tolist())}
    for b, s in zip(begin[hit].tolist(), size[hit].tolist()):
        spans = by.get(raw[b : b + s + length - 1], ())
        for j in range(0, len(spans), 2):
            start[b + spans[j] : b + spans[j + 1]] = True


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def documents(keys: pa.Array, text: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> Iterator[pa.Array]:
    spans, kept, begin = [], [], 0
    for end in ends.tolist():
        part = gone[begin:end]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))).tolist()
        spans.append([{"start": b, "end": e} for b, e in zip(edge[::2], edge[1::2])])
        kept.append(text[begin:end][~part].tobytes())
        begin = end
    yield keys
    yield pa.array(np.diff(np.append(0, ends)))
    yield pa.array(spans, pa.list_(SPAN))
    yield pa.array(kept, pa.binary())


def without_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, spans, kept) of every row: bytes of the text, the removed runs of bytes, and what is left."""
    kind = docs.schema[key].dataType.simpleString()
    shards = stored(shards_of(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")), "key", "text"), "suffix-shards")
    parts = -(-shards.count() // TOGETHER) or 1
    named = stored(shards.select("shard", "sizes", "body").mapInArrow(names(length), "name long, shard long, n long"), "suffix-runs")
    again = named.groupBy("name").agg(F.sum("n").alias("total")).where("total > 1")
    found = named.join(again, "name").groupBy("shard").agg(F.collect_list(F.struct("name", "total")).alias("found"), F.sum("n").alias("n"))
    found = stored(found, "suffix-names")
    places = found.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, places * (length + length // 2) // bucket)
    both = shards.repartition(parts, "shard").join(found.repartition(parts, "shard"), "shard")
    parted = both.select("shard", "sizes", "body", "found").mapInArrow(segments(length), "shard long, first long, name long, total long, copies long, segment binary")
    parted = parted.withColumn("deals", 1 + F.floor(F.col("total") / hot))
    deal = F.pmod(F.xxhash64("shard", "first"), F.col("deals"))
    parted = parted.withColumn("bucket", F.pmod(F.xxhash64("name", deal), F.lit(buckets)))
    marked = stored(parted.groupBy("bucket").applyInArrow(marks(length), MARKS), "suffix-marks")
    across = marked.where("name is not null").groupBy("name", "part").applyInArrow(meet, "shard long, first long, spans array<long>")
    known = marked.where("name is null").select("shard", "first", "spans").unionByName(across)
    known = known.groupBy("shard").agg(F.collect_list(F.struct("first", "spans")).alias("found"))
    last = shards.repartition(parts, "shard").join(known.repartition(parts, "shard"), "shard", "left")
    schema = f"key {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return last.select("keys", "sizes", "body", "found").mapInArrow(cut_out(length), schema).withColumnRenamed("key", key)


def digest_documents(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    out = without_repeats(docs, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
