"""Operator 2: byte-level BPE encoding and decoding with a contiguous rank array.

A short word keeps two parallel arrays, the part ids and the rank of every
adjacent pair. Each step scans the ranks for the minimum, deletes the boundary
it stands for, and refreshes the ranks on both sides. New words of one length
take these steps together, a row of the arrays each. The scan is quadratic, so
words over ``SHORT`` bytes keep the same state in a linked list with a heap of
(rank, position), which picks the same boundaries in the same order.

Cases: null text encodes as empty; an empty text has no tokens and decodes to an
empty text; special tokens of the file are recognised in the text, as the
tokenizers library does by default; long words and texts are never cut.
Repeated rows are encoded each; other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import give_back, lean, sha256_hex, sparing

#: Fixed value: the word pattern of byte-level BPE.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words up to this many bytes use the array scan.
SHORT = 96
#: Bytes of words and ids remembered in a task, and what an entry takes besides them. A half of it fills;
#: then it takes the place of the other half, and words met again move over from there.
MEMORY, ENTRY = 16_000_000, 200
#: Characters of text whose new words are encoded together.
TOGETHER = 250_000

NO_RANK = 1 << 62
#: How ids are stored in the memory of words.
ID = np.dtype("<i4")


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in the vocabulary file: printable Latin-1 letters for
    themselves, every other byte by the next free code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(sorted(set(range(256)) - set(plain))):
        letters[chr(256 + n)] = b
    return letters


class Codec:
    """Encoder and decoder over one vocabulary file's JSON text. The driver reads the text; a task gets the codec
    as sorted numbers, so that no worker holds the parsed file."""

    def __init__(self, source: str):
        data = json.loads(source)
        vocab, letters = data["model"]["vocab"], byte_letters()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = data["model"]["merges"]
        keys, values = np.zeros(len(merges), np.int64), np.zeros(len(merges), np.int64)
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            keys[rank], values[rank] = vocab[left] << 24 | vocab[right], rank << 24 | vocab[left + right]
        #: pairs of ids as sorted numbers, and for each its rank and what it becomes, as a number that orders
        #: by rank; of a pair listed twice the first counts
        self.keys, first = np.unique(keys, return_index=True)
        self.values = values[first]
        added = [(t["id"], t["content"]) for t in data.get("added_tokens", [])]
        self.special = {content: i for i, content in added}
        self.piece = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.piece[i] = bytes(letters[c] for c in token)
        for content, i in self.special.items():
            self.piece[i] = content.encode("utf-8")
        self.word = regex.compile(WORD)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def scan(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, a row of part ids each: gives (rows, parts) as words come to rest.

        Every word has its own contiguous rank array, here a row of ``ranks``. All words still at
        work delete one boundary a step, so the arrays stay rectangular.
        """
        rows = np.arange(len(parts))
        ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            every = np.arange(len(rows))
            low = ranks[every, at] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            rest = low == NO_RANK
            if rest.any():
                yield rows[rest], parts[rest]
                live = ~rest
                rows, parts, ranks, at, low = rows[live], parts[live], ranks[live], at[live], low[live]
                every = every[: len(rows)]
            if not len(rows):
                break
            join = low & 0xFFFFFF
            parts[every, at] = join
            n, width = parts.shape
            keep = np.ones((n, width), bool)
            keep[every, at + 1] = False
            parts = parts[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            has = at > 0
            ranks[every[has], at[has] - 1] = self.pair_ranks(parts[every[has], at[has] - 1], join[has])
            has = at < width - 2
            ranks[every[has], at[has]] = self.pair_ranks(join[has], parts[every[has], at[has] + 1])

    def learn(self, words: set[str]) -> None:
        """Put the ids of ``words`` into the memory."""
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8")
            if len(raw) <= SHORT:
                sized.setdefault(len(raw), []).append((w, raw))
        for size, group in sized.items():
            parts = self.byte_id[np.frombuffer(b"".join(raw for _, raw in group), np.uint8)].reshape(len(group), size)
            for rows, done in self.scan(parts):
                ids, width = done.astype(ID).tobytes(), ID.itemsize * done.shape[1]
                self.seen.update((group[r][0], ids[i * width : (i + 1) * width]) for i, r in enumerate(rows.tolist()))
                self.held += len(rows) * (ENTRY + size + width)

    def look(self, pair: tuple[int, int]) -> tuple[int, int] | None:
        """(rank, what it becomes) of one pair."""
        key = pair[0] << 24 | pair[1]
        at = int(np.searchsorted(self.keys, key))
        return divmod(int(self.values[at]), 1 << 24) if at < len(self.keys) and self.keys[at] == key else None

    def long(self, parts: list[int]) -> list[int]:
        look, n = self.look, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f[0], i, f[1], parts[i], parts[i + 1]) for i in range(n - 1) if (f := look((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, at, join, left, right = heapq.heappop(heap)
            nxt = after[at] if parts[at] == left else n
            if nxt >= n or parts[nxt] != right:
                continue  # a boundary that is gone or has other neighbours by now
            parts[at], parts[nxt] = join, -1
            after[at] = after[nxt]
            if after[at] < n:
                before[after[at]] = at
                if f := look((join, parts[after[at]])):
                    heapq.heappush(heap, (f[0], at, f[1], join, parts[after[at]]))
            if (b := before[at]) >= 0 and (f := look((parts[b], join))):
                heapq.heappush(heap, (f[0], b, f[1], parts[b], join))
        return [p for p in parts if p >= 0]

    def parted(self, text: str | None) -> list[str | int]:
        """A text's words in order, special tokens as their ids."""
        if not text or self.cut is None:
            return self.word.findall(text) if text else []
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += self.word.findall(text[at : m.start()])
            parts.append(self.special[m[0]])
            at = m.end()
        return parts + self.word.findall(text[at:] if at else text)

    def known(self, part: str | int) -> bytes:
        if isinstance(part, int):
            return ID.type(part).tobytes()
        return self.seen.get(part) or np.array(self.long([int(self.byte_id[b]) for b in part.encode("utf-8")]), ID).tobytes()

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; texts are taken together until they reach ``TOGETHER`` characters."""
        held, size = [], 0
        for t in texts:
            held.append(self.parted(t))
            size += len(t or "")
            if size >= TOGETHER:
                yield from self.flushed(held)
                held, size = [], 0
        yield from self.flushed(held)

    def flushed(self, held: list[list[str | int]]) -> Iterator[np.ndarray]:
        words = set().union(*held).difference(self.special.values())
        if self.held > MEMORY // 2:
            self.before, self.seen, self.held = self.seen, {}, 0
        new = words - self.seen.keys()
        again = new & self.before.keys()
        for w in again:
            ids = self.seen[w] = self.before[w]
            self.held += ENTRY + len(w.encode("utf-8")) + len(ids)
        self.learn(new - again)
        look = self.seen.__getitem__
        for parts in held:
            try:
                ids = b"".join(map(look, parts))
            except KeyError:  # special tokens and long words are not in the memory
                ids = b"".join(map(self.known, parts))
            yield np.frombuffer(ids, ID)

    def forget(self) -> None:
        """Empty the memory of words."""
        self.seen: dict[str, bytes] = {}  # word to its ids, four bytes each
        self.before: dict[str, bytes] = {}  # the half that filled before
        self.held = 0

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_many([text])).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(str, ids))


def vocabulary(path: str) -> str:
    """The vocabulary file's text, read once by the driver. Its size is bounded: a public file of
    some megabytes that goes to every task with the function that uses it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(source: str):
    """Column function: text to array of token ids."""
    codec = Codec(source)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in sparing(texts):
            yield pd.Series(list(codec.encode_many(part)), dtype=object)
        codec.forget()
        give_back()

    return ids


def decoder(source: str):
    """Column function: array of token ids to text (null for null)."""
    codec = Codec(source)

    @F.pandas_udf("string")
    def text(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lean(lists):
            yield pd.Series([None if x is None else codec.decode(x) for x in part], dtype=object)

    return text


def digest(source: str):
    """Column function: one pass that encodes, decodes and hashes both results."""
    codec = Codec(source)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in sparing(texts):
            rows = [(len(ids), sha256_hex(codec.listed(ids).encode()), sha256_hex(codec.decode(ids).encode("utf-8")))
                    for ids in map(np.ndarray.tolist, codec.encode_many(part))]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()
        give_back()

    return digests


def encode_documents(docs: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` with an array of token ids in column ``to`` (replaced if it exists)."""
    return docs.withColumn(to, encoder(vocabulary(path))(F.col(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids in column ``ids`` stand for in column ``to``."""
    return docs.withColumn(to, decoder(vocabulary(path))(F.col(ids)))


def digest_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    made: Column = digest(vocabulary(path))(F.col(text)).alias("made")
    return docs.select("doc_id", made).select("doc_id", "made.*")
