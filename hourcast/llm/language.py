"""Operator 10: language identification by prediction with partial matching.

Per language a context tree over bytes of order 0 to 2 is counted and frozen. A
byte costs -log2 of its share in the longest context that has seen it, plus the
escapes from the longer ones: n distinct followers among t in a context give the
escape n / (n + t) (method C); below order 0 every byte is alike. A text's exact
code length under a language is the sum over all of its bytes.

Frozen costs are looked up, not walked: the byte triples seen in training are
numbered, an array over all triples holds the number (bounded: 2^24 entries of 4
bytes a worker), and the costs of all languages of a table lie in one row. A triple that
training has not seen costs its escape plus the cost of its pair. All languages and
all their triples count; where their costs are too many for one table, the languages
are parted, every text is scored part by part, and the shortest code of all wins.

Cases: null text, or a text without a letter, is ``und`` with score 0; texts are
read whole; rows with null text, lang or doc_id teach nothing; equal code lengths
go to the smaller language; with nothing learned every text is ``und``; an empty
table gives no rows; repeated rows are judged each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import stored

#: Bytes a block; a text is read in blocks of this size, so a long one needs no more memory.
BLOCK = 1 << 20
TRIPLES = 1 << 24
ASCII_LETTER = re.compile("[A-Za-z]")
#: Costs (triples times languages) of the languages that are scored together; a language with more is
#: scored alone and has at most ``TRIPLES``.
TABLE = 1 << 23
#: Bytes of text whose triples a task holds before it sums them.
HELD = 24 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def triples(data: bytes) -> Iterator[np.ndarray]:
    """Numbers of the byte triples that end at each byte; the text starts after two spaces."""
    padded = np.frombuffer(b"  " + data, np.uint8)
    for at in range(0, len(data), BLOCK):
        b = padded[at : at + BLOCK + 2].astype(np.int32)
        yield (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]


def summed(texts: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in texts.items():
        joined = np.concatenate(parts)
        if len(joined) > BLOCK:
            n = np.bincount(joined)
            keys = np.flatnonzero(n)
            n = n[keys]
        else:
            keys, n = np.unique(joined, return_counts=True)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "triple": pa.array(keys.astype(np.int32)), "n": pa.array(n.astype(np.int64))})


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, triple, n), summed over ``HELD`` bytes of text at a time."""
    texts: dict[str, list[np.ndarray]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for t in triples(text.as_buffer().to_pybytes()):
                texts.setdefault(lang, []).append(t)
                held += len(t)
                if held >= HELD:
                    yield from summed(texts)
                    texts, held = {}, 0
    yield from summed(texts)


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # triples with costs of their own, sorted
    costs: np.ndarray  # (triple, language) bits
    pair_escape: np.ndarray  # (context of two bytes seen, language) bits of the escape
    pair_keys: np.ndarray  # contexts of two bytes, sorted
    pair_costs: np.ndarray  # (pair of bytes, language): bits of the second byte after the first alone


def frozen(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Costs of every context from (triples, n) per language."""
    keys = np.unique(np.concatenate([k for k, _ in counts.values()])) if counts else np.zeros(0, np.int64)
    pair_keys = np.unique(keys >> 8)
    costs = np.zeros((len(keys), len(languages)), np.float32)
    escape = np.zeros((len(pair_keys), len(languages)), np.float32)
    pairs = np.zeros((1 << 16, len(languages)), np.float32)
    for i, lang in enumerate(languages):
        k, n = counts[lang]
        n = n.astype(float)
        order0 = np.bincount(k & 255, n, 256)
        t0, d0 = order0.sum(), np.count_nonzero(order0)
        p0 = np.where(order0 > 0, order0 / (t0 + d0), d0 / (t0 + d0) / max(1, 256 - d0))
        order1 = np.bincount(k & 0xFFFF, n, 1 << 16).reshape(256, 256)
        t1, d1 = order1.sum(1, keepdims=True), np.count_nonzero(order1, axis=1)[:, None]
        escaped1 = np.where(t1 > 0, d1 / np.maximum(t1 + d1, 1), 1.0)
        p1 = np.where(order1 > 0, order1 / np.maximum(t1 + d1, 1), escaped1 * p0[None, :]).reshape(-1)
        pairs[:, i] = -np.log2(p1)
        context = np.searchsorted(pair_keys, k >> 8)
        t2, d2 = np.bincount(context, n, len(pair_keys)), np.bincount(context, minlength=len(pair_keys))
        escaped2 = np.where(t2 > 0, d2 / np.maximum(t2 + d2, 1), 1.0)
        escape[:, i] = -np.log2(escaped2)
        own = escaped2[np.searchsorted(pair_keys, keys >> 8)] * p1[keys & 0xFFFF]
        own[np.searchsorted(keys, k)] = n / (t2 + d2)[context]
        costs[:, i] = -np.log2(own)
    return Model(languages, keys, costs, escape, pair_keys, pairs)


def counted(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, triple, n) over all rows of ``docs`` that ``learnable`` says teach."""
    taught = docs.where(learnable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = taught.mapInArrow(count, "lang string, triple int, n long").groupBy("lang", "triple").agg(F.sum("n").alias("n"))
    return stored(sums, "language-counts")


def together(sums: DataFrame) -> list[list[str]]:
    """All languages in order, parted so that each part's costs stay within ``TABLE``, a single language's aside."""
    parts: list[list[str]] = []
    held = 0
    for r in sorted(sums.groupBy("lang").count().collect(), key=lambda r: r["lang"]):
        held += r["count"]
        if not parts or held * (len(parts[-1]) + 1) > TABLE:
            parts.append([])
            held = r["count"]
        parts[-1].append(r["lang"])
    return parts


def model_of(sums: DataFrame, languages: list[str]) -> Model:
    """The frozen costs of ``languages`` from every triple counted in them."""
    counts = {}
    for name in languages:
        mine = sums.where(F.col("lang") == name).select("triple", "n").toArrow()
        triple, n = (mine.column(c).to_numpy() for c in ("triple", "n"))
        order = np.argsort(triple)
        counts[name] = (triple[order].astype(np.int64), n[order])
    return frozen(languages, counts)


def learn(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang") -> Model:
    """One model of all languages; ``predict_documents`` parts them instead if their costs are many."""
    sums = counted(docs, learnable, text, lang)
    return model_of(sums, [name for part in together(sums) for name in part])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.number = np.full(TRIPLES, -1, np.int32)
        self.number[model.keys] = np.arange(len(model.keys), dtype=np.int32)

    def bits(self, data: bytes) -> np.ndarray:
        """Exact code length of the bytes under every language."""
        m, total = self.model, np.zeros(len(self.model.languages))
        for t in triples(data):
            at = self.number[t]
            new = at < 0
            if new.any():
                fresh = t[new]
                at = at[~new]
                context = np.searchsorted(m.pair_keys, fresh >> 8)
                context[context == len(m.pair_keys)] = 0
                seen = m.pair_keys[context] == fresh >> 8
                total += m.pair_costs[fresh & 0xFFFF].sum(0, dtype=float) + m.pair_escape[context[seen]].sum(0, dtype=float)
            total += m.costs[at].sum(0, dtype=float)
        return total

    def best(self, text: str | None) -> tuple[str, float, float]:
        """The language of the shortest code, its length, and the likelihood of all languages as a multiple of its own."""
        if not self.model.languages or not has_letter(text):
            return "und", 0.0, 0.0
        bits = self.bits(text.encode("utf-8"))
        best = int(bits.argmin())
        return self.model.languages[best], float(bits[best]), float(np.exp2(np.minimum(0, bits[best] - bits)).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, _, times = self.best(text)
        return lang, 1 / times if times else 0.0


def predictor(model: Model):
    """Column function: text to (lang_pred, score); the score is the best language's posterior under equal priors."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in texts:
            yield pd.DataFrame([scorer.predict(t) for t in part], columns=["lang_pred", "score"])

    return predict


def finder(model: Model):
    """Column function: text to (lang, bits, times) of the best of the model's languages."""

    @F.pandas_udf("lang string, bits double, times double")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in texts:
            yield pd.DataFrame([scorer.best(t) for t in part], columns=["lang", "bits", "times"])

    return find


def held_out(key: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1. A null id is in it."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def predict_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out."""
    sums = counted(docs, ~held_out(F.col("doc_id")))
    parts = together(sums)
    if len(parts) < 2:
        model = model_of(sums, parts[0] if parts else [])
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model)(F.col("text")).alias("x")).select("doc_id", "held_out", "x.*")
    rows = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), "text"), "language-texts")
    found = None
    for part in parts:  # one table after the other is in memory
        x = stored(rows.select("row_no", finder(model_of(sums, part))(F.col("text")).alias("x")), "language-bits")
        found = x if found is None else found.unionByName(x)
    best = found.groupBy("row_no").agg(F.min(F.struct("x.bits", "x.lang")).alias("b"), F.collect_list("x").alias("all"))
    times = F.aggregate("all", F.lit(0.0), lambda s, x: s + x["times"] * F.pow(F.lit(2.0), F.col("b.bits") - x["bits"]))
    best = best.select("row_no", F.col("b.lang").alias("lang_pred"), times.alias("times"))
    score = F.when(F.col("times") > 0, 1 / F.col("times")).otherwise(0.0)
    out = rows.select("doc_id", "row_no").join(best, "row_no")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", score.alias("score"))
