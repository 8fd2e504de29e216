"""Vector codes, collocations and suffix-array dedup against plain restatements."""

import hashlib
import random

import llm_brute as brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hourcast.llm import collocations, suffix_dedup, vector_codes


# vector codes

@settings(max_examples=100, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(1, 40), st.integers(0, 2**31))
def test_masks_find_the_nearest_entry(entries, dim, rows, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-6, 6, (entries, dim)), rng.integers(-9, 9, (rows, dim))
    entry, far = vector_codes.Codebook(book).nearest(x)
    every = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert entry.tolist() == every.argmin(1).tolist() and far.tolist() == every.min(1).tolist()


def test_masks_hold_all_entries_within_the_radius():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-50, 50, (64, 4)), rng.integers(-50, 50, (30, 4))
    mask = vector_codes.Codebook(book).masks(x, np.full(30, 20))
    box = (np.abs(x[:, None, :] - book[None]) <= 20).all(2)
    assert [[bool(int(m) >> e & 1) for e in range(64)] for m in mask] == box.tolist()


def coded(rows, spark, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error string")
    return sorted(map(tuple, vector_codes.code_vectors(df.repartition(3), **options).collect()), key=repr)


def test_vector_codes_equal_brute_force(spark):
    rng = random.Random(5)
    kept = [(i if i % 17 else None, [float(np.float32(rng.gauss(0, 1))) for _ in range(rng.choice([32, 32, 32, 20]))], rng.choice([None, 1, 1, 1, 2])) for i in range(200)]
    kept += [(7, kept[7][1], 1), (7, kept[8][1], 3), (500, [], 2)]  # repeated ids, an empty vector
    odd = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")], 1), (903, [float("inf")] * 32, 2)]
    got = coded([(*r, "x", "y") for r in kept + odd], spark)
    want, books = brute.codes([(i, v) for i, v, _ in kept])
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == sorted((r[0], r[1], r[2]) for r in want if r[0] is not None)
    assert sorted(r[1:3] for r in got) == sorted(r[1:] for r in want)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert {r[4] for r in got} == {digest}
    by = {(i, c): e for i, c, e in want}
    label = {}
    codes = {(i, tuple(v)): None for i, v, _ in kept}
    order = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    for (i, v, lab), (_, c, e) in zip(order, want):
        label[lab] = label.get(lab, 0) + e
    assert sorted(r[3] for r in got) == sorted(label[lab] for _, _, lab in kept) and by and codes


def test_vector_codes_of_few_and_no_rows(spark):
    assert coded([], spark) == [] and coded([(1, None, 1, "", "")], spark) == []
    got = coded([(2, [0.5] * 16, None, "", ""), (1, [-0.5] * 16, None, "", "")], spark)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        coded([(1, [1e30] * 16, None, "", "")], spark)


def test_label_totals_of_hot_and_rare_keys(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else str(i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k string, v long")
    want = {}
    for _, k, v in rows:
        want[k] = want.get(k, 0) + v
    got = vector_codes.with_totals(df, "k", "v", "total").collect()
    assert len(got) == 3000 and all(r["total"] == want[r["k"]] for r in got)


# collocations

def found(docs, **options):
    return sorted((tuple(r) for r in collocations.collocations(docs, **options).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("least,top", [(8, 40), (25, 2000), (3, 15)])
def test_collocations_equal_brute_force(small, least, top):
    want = brute.phrases([(r["text"], r["lang"]) for r in small.select("text", "lang").collect()], least, top)
    assert found(small, least=least, top=top) == sorted(want, key=lambda r: (r[0], r[1]))


def test_collocations_of_odd_rows(tricky, empty):
    rows = [(r["text"], r["lang"]) for r in tricky.select("text", "lang").collect()]
    got = found(tricky, least=2, top=50)
    assert got == sorted(brute.phrases(rows, 2, 50), key=lambda r: (r[0], r[1])) and any(r[0] == "und" for r in got) is False
    assert found(empty) == [] and found(tricky, least=10**6) == []


def test_collocation_ties_and_neighbours(spark):
    texts = [("a b c d e f", None), ("a b c d e f", "und"), ("x y. x y; y x", "und"), ("A\tB", "fr"), ("a b", "fr"), ("\x1c a \x00 b", "fr")] * 3
    docs = spark.createDataFrame(texts, "text string, lang string")
    assert found(docs, least=2, top=3) == sorted(brute.phrases(texts, 2, 3), key=lambda r: (r[0], r[1]))


def test_collocations_over_small_slices(small, monkeypatch):
    """Phrases that cross the stretches worked on together, and chunks, count as others."""
    want = found(small, least=10, top=300)
    for name, value in (("SLICE", 7), ("HELD", 50)):
        monkeypatch.setattr(collocations, name, value)
    few = small.limit(60)
    rows = [(r["text"], r["lang"]) for r in few.select("text", "lang").collect()]
    assert found(few, least=4, top=300) == sorted(brute.phrases(rows, 4, 300), key=lambda r: (r[0], r[1]))
    monkeypatch.setattr(collocations, "SLICE", 1000)
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    assert found(small, least=10, top=300) == want


def test_filter_lets_all_through(spark):
    numbers = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    kept = collocations.filter_of(spark.createDataFrame([(int(x),) for x in numbers], "g long"))
    assert kept.has(numbers.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(1, 2**63 - 1, 5000).view(np.uint64)
    assert kept.has(other).mean() < 0.05 and not kept.has(np.zeros(1, np.uint64)).any()


# suffix arrays

@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=10, unique=True), st.sampled_from([b"ab", b"\0\xff", bytes(range(256))]))
def test_suffix_array_and_common_prefixes(segments, letters):
    segments = list(dict.fromkeys(bytes(letters[c % len(letters)] for c in s) for s in segments))
    keys, ends, begins = suffix_dedup.packed_symbols(segments)
    order = suffix_dedup.suffix_array(keys, ends)
    at = np.searchsorted(begins, order, "right") - 1
    suffixes = [segments[s][p - begins[s] :] for s, p in zip(at, order)]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(map(len, segments))
    shared = [next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(suffixes, suffixes[1:])]
    sizes = ends[begins] - begins
    assert suffix_dedup.common_prefixes(keys, ends, order, begins, sizes).tolist() == [0, *shared]
    # a walk over the first places alone finds the same there
    part = suffix_dedup.common_prefixes(keys, ends, order, begins, sizes // 2)
    assert [x for x, p, s in zip(part, order, at) if p - begins[s] < sizes[s] // 2] == [x for x, p, s in zip([0, *shared], order, at) if p - begins[s] < sizes[s] // 2]


def test_equal_windows_have_equal_names():
    rng = np.random.default_rng(4)
    a, b, c = (rng.integers(0, 4, n, dtype=np.uint8) for n in (300, 260, 90))
    text = np.concatenate([a, b, c, b, a, np.zeros(150, np.uint8)])
    ends = np.cumsum([300, 260, 90, 260, 300, 150])
    begin, size, name = suffix_dedup.runs(text, ends, 40)
    named = {int(p): int(x) for b, s, x in zip(begin, size, name) for p in range(b, b + s)}
    raw, seen = text.tobytes(), {}
    want = [i for e, n in zip(ends, (300, 260, 90, 260, 300, 150)) for i in range(e - n, e - 40 + 1)]
    assert sorted(named) == want
    for i in want:
        assert seen.setdefault(raw[i : i + 40], named[i]) == named[i]


def removed(docs, **options):
    got = suffix_dedup.without_repeats(docs, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got), key=repr)


def plain(docs, length):
    rows = docs.select("doc_id", "text").collect()
    return sorted(((r["doc_id"], *x) for r, x in zip(rows, brute.without_repeats([r["text"] for r in rows], length))), key=repr)


@pytest.mark.parametrize("length,hot,bucket", [(200, 4096, 2 << 20), (200, 2, 20_000), (40, 1, 5_000)])
def test_repeats_equal_brute_force(small, length, hot, bucket):
    assert removed(small, length=length, hot=hot, bucket=bucket) == plain(small, length)


def test_repeats_of_odd_rows(tricky, empty):
    docs = tricky.where("doc_id is null or doc_id not in (10, 12)")
    assert removed(docs, length=30) == plain(docs, 30)
    assert removed(empty) == []


def test_repeats_of_long_texts(spark, monkeypatch):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcde ") for _ in range(400))
    texts = ["12 " * 20_000, "x" * 1_000, "".join(rng.choice("ab") for _ in range(50_000)), passage, passage[:199], "é" * 150 + passage[100:301] + "ü" * 99]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(docs) == plain(docs, 200)
    begin, size, _ = suffix_dedup.runs(np.frombuffer(texts[0].encode(), np.uint8), np.array([60_000]), 200)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1 << 12)
    cut = suffix_dedup.runs(np.frombuffer(texts[0].encode(), np.uint8), np.array([60_000]), 200)
    assert sum(cut[1]) == sum(size) == 60_000 - 199 and len(begin) <= len(cut[0])


def test_hot_names_meet_across_arrays(spark):
    """One passage in many texts, each between other words: its edges lie in several suffix arrays."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(230)
    rows = [(i, word(150) + passage + word(150)) for i in range(60)] + [(60 + i, "same head " * 9 + passage + word(50)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (1, 3, 4096):
        assert removed(docs, hot=hot) == plain(docs, 200)
