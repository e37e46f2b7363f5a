"""Token ids of texts by a public byte-level BPE tokenizer, in batched numpy merge rounds.

Texts are cut into words by the tokenizer's public pattern. The words that a
task hasn't met yet are put into one flat array of symbols; each round looks
up all neighbouring pairs by binary search over the sorted pair keys, merges
every occurrence of each word's lowest-ranked pair, and takes out the words
that have no pair left. A pair made by a merge always ranks after the merge
that made its parts, so merging all occurrences at once equals merging them
one by one from the left.

Tasks keep the ids of the words they met (at most ``KNOWN_WORDS``, then they
start anew), take texts in pieces of bounded size, and shuffle nothing. The
vocabulary file is read by each Python worker from ``vocabulary``, a path that
every executor can read; no special token is ever produced.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.batches import slices
from fathomline.session import spread

#: Where the public vocabulary lies; a parameter of every function below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern that splits text into words before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task keeps, and words that are looked up at a time.
KNOWN_WORDS, WORDS_AT_ONCE = 500_000, 400_000
#: Longer words (runs without a break) aren't kept.
KEPT_LENGTH = 64

_NONE = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The merges of a byte-level BPE as sorted pair keys with their ranks and merged ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.of_byte[byte] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = int(max(ids.values())) + 1
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        #: The bytes of each id; each letter of the vocabulary stands for one.
        self.bytes_of = np.zeros(self.width, np.int64)
        self.bytes_of[list(ids.values())] = [len(token) for token in ids]

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair its place among the keys and its rank, _NONE if it never merges."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's ids begin and end (one more than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbol):
            at, rank = self.ranked(symbol[:-1], symbol[1:])
            rank = np.append(np.where(word[1:] == word[:-1], rank, _NONE), _NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = best == _NONE
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
            hit = np.flatnonzero((rank == best) & ~over)
            if len(hit) > 1:  # of pairs that overlap, as in "aaa", every other one
                fresh = np.append(True, np.diff(hit) != 1)
                run = np.cumsum(fresh) - 1
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(fresh)[run]) % 2 == 0]
            symbol[hit] = self.merged[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
        return ids[order].astype(np.int32), ends


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts and remembers words. One for each task."""

    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.find = regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _look_up(self, words: list[str]) -> np.ndarray:
        """The number of each word among the known ones; unknown ones are encoded first."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            ids, ends = self.words.encode([w.encode() for w in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, ends[:-1] + len(self.flat)])
            self.sizes = np.concatenate([self.sizes, np.diff(ends)])
            self.flat = np.concatenate([self.flat, ids])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
        """Words of consecutive texts, some at a time, with the number of words of each text in them."""
        words: list[str] = []
        counts: list[int] = []
        for text in texts:
            before = len(words)
            if text and len(text) > WORDS_AT_ONCE:
                found = (m.group() for m in self.find.finditer(text))
                while part := list(islice(found, WORDS_AT_ONCE - len(words))):
                    words += part
                    if len(words) >= WORDS_AT_ONCE:
                        yield words, [*counts, -(len(words) - before)]  # the text goes on
                        words, counts, before = [], [], 0
            elif text:
                words += self.find.findall(text)
            counts.append(len(words) - before)
            if len(words) >= WORDS_AT_ONCE:
                yield words, counts
                words, counts = [], []
        yield words, counts

    def encode(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array (empty if only counts are wanted), and the number of each text's ids."""
        parts, totals, open_total = [], [], 0
        for words, counts in self._pieces(texts):
            at = self._look_up(words)
            sizes = self.sizes[at]
            so_far = np.concatenate([[0], np.cumsum(sizes)])
            if not counts_only:
                begins = self.starts[at] - so_far[:-1]
                parts.append(self.flat[np.repeat(begins, sizes) + np.arange(so_far[-1])])
            i = 0
            for c in counts:
                open_total += int(so_far[i + abs(c)] - so_far[i])
                i += abs(c)
                if c >= 0:
                    totals.append(open_total)
                    open_total = 0
            if len(self.known) > KNOWN_WORDS or len(self.flat) > 8 * KNOWN_WORDS:
                self._forget()
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.array(totals, np.int64)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, without special tokens."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in slices(batches, "text"):
            ids, counts = encoder.encode(part.column("text").to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return spread(source).mapInArrow(encode, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every text; the ids are never built."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in slices(batches, "_text"):
            counts = encoder.encode(part.column("_text").to_pylist(), counts_only=True)[1]
            columns = [*part.select(keep).columns, pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens"])

    return source.mapInArrow(count, f"{schema}, n_tokens long")
