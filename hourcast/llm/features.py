"""Plain statistics of a text, shared by the learned filters (operators 1 and 9)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import lean

WS = re.compile(r"[\x20\x09-\x0D]")
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more in the text, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal keys: nothing repeats
    windows = list(zip(*(words[i : i + n] for i in range(WINDOW))))
    times = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if times[w] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    blank = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()] if "\n" in text else []
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digit", "n_bang", "n_lines", "n_distinct")


def measures(text: str | None) -> tuple[int, ...]:
    """``base`` and further counts: upper-case letters, digits, exclamation marks, lines, distinct words."""
    if not text:
        return (0,) * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    upper = int(by_byte[65:91].sum())
    return (*base(text), upper, int(by_byte[48:58].sum()), int(by_byte[33]), 1 + int(by_byte[10]), len(set(raw.tobytes().split())))


def measured(text: Column) -> Column:
    """All of ``NAMES`` as one struct."""

    @F.pandas_udf(", ".join(f"{n} long" for n in NAMES))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in lean(texts):
            yield pd.DataFrame([measures(t) for t in part], columns=list(NAMES))

    return run(text)


#: Rates that the learned filters see, as SQL over the counts; none depends on the text's length alone.
RATES = {
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digit / greatest(word_chars, 1)",
    "bang_rate": "n_bang / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "log_words": "ln(1 + n_words)",
}


def with_rates(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.expr(f"cast({sql} as double)").alias(name) for name, sql in RATES.items()))
