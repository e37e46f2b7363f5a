"""Splitting texts at natural boundaries, with overlap.

For each text three sorted arrays of offsets are made (paragraph, line and
sentence ends; white space and punctuation; single characters are implied).
A piece ends at the last boundary under the limit, found by binary search; the
next piece starts up to ``overlap`` characters before that end, at a natural
start if there is one. Where no boundary lies under the limit the text is cut
hard.

Limit and overlap count characters, or tokens of a public tokenizer: then prefix
sums of the lengths of the text's tokens say, by binary search, how far a
number of tokens reaches from any place. A piece's size is the number of the
text's tokens that it holds or touches.

Arrow batches of texts are cut in the tasks that read them: nothing is
shuffled and pieces never leave their row's task. Offsets count code points.

Defined cases: null and empty contents have no piece; a content within the
limit is one piece; CR LF pairs and base characters with their combining marks
stay together unless a run of marks is longer than the limit; repeated rows
are cut each; further columns of the input are ignored unless asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.batches import slices
from fathomline.llm.tokens import VOCABULARY, Encoder
from fathomline.session import spread

LIMIT, OVERLAP = 1200, 120
#: The same in tokens.
TOKEN_LIMIT, TOKEN_OVERLAP = 300, 30

#: Marks that end a clause or more and may be cut after; with white space they make the weak boundaries (fixed values).
MARKS = ".,;:!?。，；：！？、"
#: Marks that end a sentence.
STOPS = ".!?。！？"

_EOL = "(?:\\r\\n|[\\n\\r\\u0085\\u2028\\u2029])"
_PARAGRAPH = re.compile(rf"{_EOL}(?:[ \t]*{_EOL})+[ \t]*")
_LINE = re.compile(_EOL)
_SENTENCE = re.compile(r"[.!?]+[\"'”’)\]]*(?:\s+|$)|[。！？]+[”’」』）]*\s*")
_WEAK = re.compile(rf"\s+|[{re.escape(MARKS)}]")


def _ends(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)


def _last_under(bounds: np.ndarray, low: int, high: int) -> int:
    """The last boundary in (low, high], or -1."""
    i = int(np.searchsorted(bounds, high, side="right")) - 1
    return int(bounds[i]) if i >= 0 and bounds[i] > low else -1


def _first_from(bounds: np.ndarray, low: int, high: int) -> int:
    """The first boundary in [low, high), or -1."""
    i = int(np.searchsorted(bounds, low, side="left"))
    return int(bounds[i]) if i < len(bounds) and bounds[i] < high else -1


def _joined(text: str, at: int) -> bool:
    """Whether the characters around an offset belong together."""
    before, after = text[at - 1], text[at]
    return before + after == "\r\n" or before == "\u200d" or after in "\u200d\ufe0f" or unicodedata.combining(after) > 0


class Characters:
    """Sizes in characters."""

    def __init__(self, text: str):
        self.n = len(text)

    def reach(self, start: int, size: int) -> int:
        """How far at most a piece of a size goes from a place."""
        return min(start + size, self.n)

    def back(self, end: int, size: int) -> int:
        """Where a size before a place begins."""
        return max(end - size, 0)

    def size(self, start: int, end: int) -> int:
        return end - start


class Tokens:
    """Sizes in tokens: prefix sums of the tokens' lengths in bytes, as offsets of characters."""

    def __init__(self, text: str, encoder: Encoder):
        self.n = len(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        number = np.cumsum((raw & 0xC0) != 0x80)  # of the character that a byte belongs to, from 1
        ends = np.cumsum(encoder.words.bytes_of[encoder.encode([text])[0]])
        self.starts = number[np.append(0, ends[:-1])] - 1 if len(ends) else ends
        self.ends = number[ends - 1] if len(ends) else ends

    def reach(self, start: int, size: int) -> int:
        first = int(np.searchsorted(self.ends, start, side="right"))
        if first + size >= len(self.ends):
            return self.n
        # the next token's first character is out of reach; of a character of more tokens than the limit one is taken whole
        return max(int(self.starts[first + size]), start + 1)

    def back(self, end: int, size: int) -> int:
        last = int(np.searchsorted(self.starts, end, side="left"))
        return int(self.starts[max(last - size, 0)]) if size else end

    def size(self, start: int, end: int) -> int:
        return int(np.searchsorted(self.starts, end, side="left") - np.searchsorted(self.ends, start, side="right"))


def cut_points(
    text: str, limit: int = LIMIT, overlap: int = OVERLAP, measure: Characters | Tokens | None = None
) -> list[tuple[int, int, str]]:
    """The pieces of a text as (start, end, how its end was cut); limit and overlap in the sizes of ``measure``."""
    n = len(text)
    measure = measure or Characters(text)
    if measure.reach(0, limit) >= n:
        return [(0, n, "end")] if n else []
    weak = _ends(_WEAK, text)
    paragraphs, lines = _ends(_PARAGRAPH, text), _ends(_LINE, text)
    sentences = _ends(_SENTENCE, text)
    natural = np.unique(np.concatenate([paragraphs, lines, sentences]))
    starts = np.unique(np.concatenate([natural, weak]))
    levels = (("paragraph", paragraphs), ("line", lines), ("sentence", natural))
    pieces: list[tuple[int, int, str]] = []
    start = done = 0
    while (high := measure.reach(start, limit)) < n:
        end, how = -1, "hard"
        # a paragraph or line end is preferred if it fills half of the piece
        for name, bounds in levels:
            low = max(done, start + (high - start) // 2) if name != "sentence" else done
            if (end := _last_under(bounds, low, high)) > 0:
                how = name
                break
        else:
            if (end := _last_under(weak, done, high)) > 0:
                how = "weak"
            else:
                # before a mark or within white space no run is broken
                how = "weak" if _WEAK.match(text, high) or text[high - 1].isspace() else "hard"
                end = high
                while end > done + 1 and high - end < 64 and _joined(text, end):
                    end -= 1
                if _joined(text, end):
                    end = high
        pieces.append((start, end, how))
        done = end
        back = max(measure.back(end, overlap), start + 1)
        start = _first_from(natural, back, end)
        if start < 0:
            start = _first_from(starts, back, end)
        if start < 0:
            start = min(back, end)
        if measure.reach(start, limit) <= end:  # the overlap alone would fill the next piece
            start = end
    pieces.append((start, n, "end"))
    return pieces


PIECE = "piece int, start_pos long, n_chars int, cut string, text string"
PIECE_NAMES = ["piece", "start_pos", "n_chars", "cut", "text"]
PIECE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]


def split(
    rows: DataFrame,
    text: str,
    keep: list[str],
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    longer_only: bool = False,
    in_tokens: bool = False,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``keep`` columns and ``piece, start_pos, n_chars, cut, text`` for each piece, in order of ``piece`` from 1.

    ``cut`` says how the piece ends: 'paragraph', 'line', 'sentence', 'weak'
    (white space or punctuation), 'hard', or 'end' of the text. With
    ``in_tokens`` limit and overlap count tokens, and ``n_tokens`` is given as well.
    """
    # a text has no more tokens than bytes, and no fewer than one
    source = rows.select(*keep, F.col(text).alias("_text")).where(F.length("_text") > (limit if longer_only and not in_tokens else 0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", " + PIECE
    names, types = [*keep, *PIECE_NAMES], list(PIECE_TYPES)
    if in_tokens:
        schema, names, types = f"{schema}, n_tokens int", [*names, "n_tokens"], [*types, pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary) if in_tokens else None
        for batch in slices(batches, "_text"):
            rows_at, out = [], []
            for i, content in enumerate(batch.column("_text").to_pylist()):
                measure = Tokens(content, encoder) if encoder else Characters(content)
                pieces = cut_points(content, limit, overlap, measure)
                if longer_only and len(pieces) < 2:
                    continue
                for k, (a, b, how) in enumerate(pieces):
                    rows_at.append(i)
                    piece = (k + 1, a + 1, b - a, how, content[a:b])
                    out.append((*piece, measure.size(a, b)) if encoder else piece)
            kept = batch.select(keep).take(pa.array(rows_at, pa.int64()))
            made = [pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays(kept.columns + made, names=names)

    return spread(source).mapInArrow(cut, schema)


def kinds(rows: DataFrame, text: str, key: str = "id", limit: int = LIMIT) -> DataFrame:
    """``key, kind, n_pieces`` of each text over the limit: 'hard' if it can't be cut into pieces without a hard cut.

    It is cut without overlap, so that each piece begins where the one before ended:
    then a piece is cut hard exactly where more characters than the limit follow one
    another without white space and without any of MARKS.
    """
    source = rows.select(F.col(key).alias("id"), F.col(text).alias("_text")).where(F.length("_text") > limit)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            made = [cut_points(content, limit, 0) for content in batch.column("_text").to_pylist()]
            kind = pa.array(["hard" if any(how == "hard" for *_, how in pieces) else "soft" for pieces in made], pa.string())
            sizes = pa.array([len(pieces) for pieces in made], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), kind, sizes], names=["id", "kind", "n_pieces"])

    return spread(source).mapInArrow(judge, f"id {source.schema['id'].dataType.simpleString()}, kind string, n_pieces int")


def rebuilt(pieces: DataFrame, key: str) -> DataFrame:
    """``key, text, n_pieces, longest``: texts put together again from their pieces, each from where the one before ended."""
    ordered = F.array_sort(F.collect_list(F.struct("piece", "start_pos", "n_chars", "text")))
    step = lambda text, p: F.concat(text, F.substring(p["text"], F.length(text) + 2 - p["start_pos"].cast("int"), p["n_chars"]))
    return pieces.groupBy(key).agg(
        F.aggregate(ordered, F.lit(""), step).alias("text"), F.count("*").alias("n_pieces"), F.max("n_chars").alias("longest")
    )
