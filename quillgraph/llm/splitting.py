"""Splitting oversized texts at natural boundaries.

Method: lexical-cohesion segmentation.  The text is cut into units (paragraphs,
sentences, words, or characters, the coarsest kind whose units all fit).
Sliding blocks on both sides of every gap between units are compared by word
overlap (cosine); a gap's depth is how far its similarity lies below the peaks
to its left and right.  Each piece ends at the deepest valley inside its size
window (all gaps up to ``limit`` characters from its start, the last of equally
deep ones), and the next piece repeats up to ``overlap`` characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.sentences import paragraph_spans, sentence_spans

LEVELS = ("paragraph", "sentence", "word", "char")
_WORD = re.compile(r"[^\W_]+")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")


def _words(text: str) -> list[str]:
    out = []
    for w in _WORD.findall(text.lower()):
        if _SPACELESS.search(w):
            out.extend(w[i:i + 2] for i in range(len(w) - 1))
        elif len(w) > 3:
            out.append(w)
    return out


def units(text: str, limit: int, lang: str | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The first level whose units all have at most ``limit`` characters, and those units (none listed for single characters)."""
    spans = paragraph_spans(text)
    if spans and all(b - a <= limit for a, b in spans):
        return "paragraph", spans
    spans = sentence_spans(text, lang)
    if spans and all(b - a <= limit for a, b in spans):
        return "sentence", spans
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if spans and all(b - a <= limit for a, b in spans):
        return "word", spans
    return "char", []


class _Blocks:
    """Word counts left and right of a gap with their dot product, kept up word by word."""

    def __init__(self):
        self.sides: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.squares = [0, 0]
        self.dot = 0

    def add(self, side: int, words: list[str]) -> None:
        mine, other = self.sides[side], self.sides[1 - side]
        for w in words:
            n = mine.get(w, 0)
            mine[w] = n + 1
            self.squares[side] += 2 * n + 1
            self.dot += other.get(w, 0)

    def drop(self, side: int, words: list[str]) -> None:
        mine, other = self.sides[side], self.sides[1 - side]
        for w in words:
            n = mine[w] - 1
            mine[w] = n
            self.squares[side] -= 2 * n + 1
            self.dot -= other.get(w, 0)

    def cosine(self) -> float:
        a, b = self.squares
        return self.dot / math.sqrt(a * b) if a and b else 0.0


def depths(text: str, spans: list[tuple[int, int]], block: int) -> list[float]:
    """Depth of the similarity valley at every gap between consecutive units.

    Blocks hold about ``block`` words on each side and slide over the units; every
    word enters and leaves each side once.
    """
    bags = [_words(text[a:b]) for a, b in spans]
    n = len(spans)
    sims = []
    blocks = _Blocks()
    lo, hi, ln, rn = 0, 0, 0, 0  # left block: units lo..g, right block: g+1..hi-1
    for g in range(n - 1):
        blocks.add(0, bags[g])
        ln += len(bags[g])
        while lo < g and ln - len(bags[lo]) >= block:
            ln -= len(bags[lo])
            blocks.drop(0, bags[lo])
            lo += 1
        if g < hi:
            rn -= len(bags[g])
            blocks.drop(1, bags[g])
        hi = max(hi, g + 1)
        while hi < n and rn < block:
            blocks.add(1, bags[hi])
            rn += len(bags[hi])
            hi += 1
        sims.append(blocks.cosine())
    # peaks: climb from each gap while similarity rises
    peak_left, run, best = [], 0.0, 0.0
    for i, s in enumerate(sims):
        run = max(s, run if i and sims[i - 1] >= s else s)
        peak_left.append(run)
    peak_right = [0.0] * len(sims)
    for i in range(len(sims) - 1, -1, -1):
        best = max(sims[i], best if i + 1 < len(sims) and sims[i + 1] >= sims[i] else sims[i])
        peak_right[i] = best
    return [peak_left[i] + peak_right[i] - 2 * s for i, s in enumerate(sims)]


def _overlap_start(text: str, end: int, at: int) -> int:
    """Start of the repeated tail ``at``..``end``, moved to a word boundary if the tail has one."""
    if 0 < at < end and not text[at - 1].isspace() and not text[at].isspace():
        nxt = re.search(r"\s+", text[at:end])
        if nxt and at + nxt.end() < end:
            at += nxt.end()
    while at < end and text[at].isspace():
        at += 1
    return at


def split_text(text: str, limit: int = 1000, overlap: int = 100, lang: str | None = None) -> tuple[str, list[tuple[int, int]]]:
    """(cut level, piece spans) of a text longer than ``limit``; every character that is not whitespace at a cut is covered."""
    level, spans = units(text, limit, lang)
    n = len(spans)
    if level == "char":
        pieces, at = [], 0
        while True:
            end = min(len(text), at + limit)
            pieces.append((at, end))
            if end == len(text):
                return level, pieces
            at = end - min(overlap, limit - 1)
    scores = depths(text, spans, block=40)
    if level == "word":
        # depth first counts where blocks differ; among plain gaps a line end or punctuation is the better cut
        scores = [s + (0.05 if text[spans[i][1] - 1] in ".!?;:,。、，" or "\n" in text[spans[i][1]:spans[i + 1][0]] else 0.0) for i, s in enumerate(scores)]
    pieces: list[tuple[int, int]] = []
    start, first = spans[0][0], 0
    while first < n:
        last = first
        while last + 1 < n and spans[last + 1][1] - start <= limit:
            last += 1
        if last < n - 1:
            last = max(range(first, last + 1), key=lambda i: (scores[i], i))
        end = spans[last][1]
        pieces.append((start, end))
        first = last + 1
        if first < n:
            # the repeated tail, as far as it leaves room for the next unit
            floor = max(start + 1, end - overlap, spans[first][1] - limit)
            start = _overlap_start(text, end, floor) if floor < end else end
            if start >= end:
                start = spans[first][0]
    return level, pieces


_SCHEMA = pa.schema([("doc_key", pa.int64()), ("cut_level", pa.string()), ("piece_no", pa.int32()), ("piece_start", pa.int64()),
                     ("piece_end", pa.int64()), ("piece", pa.string())])


def _cutter(limit: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _SCHEMA]
            for key, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                level, pieces = split_text(text, limit, overlap, lang)
                for n, (s, e) in enumerate(pieces):
                    for c, v in zip(cols, (key, level, n, s, e, text[s:e]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)
    return cut


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 100, lang_col: str | None = None) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters.

    Result: ``id_col, cut_level, piece_no, piece_start, piece_end, piece``; a piece
    has at most ``limit`` characters and starts with up to ``overlap`` characters
    from the end of the one before (fewer where the next unit leaves no room).
    Shorter, null and empty texts give no row; a text of blanks only is cut at
    characters.  ``lang_col`` names the language of a row for its sentences.
    Repeated rows are cut each.  No shuffle.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_key"), F.col(text_col).alias("text"), lang.alias("lang")).where(
        (F.length("text") > limit) & F.col("doc_key").isNotNull())
    out = rows.mapInArrow(_cutter(limit, overlap), "doc_key bigint, cut_level string, piece_no int, piece_start bigint, piece_end bigint, piece string")
    return out.withColumnRenamed("doc_key", id_col)
