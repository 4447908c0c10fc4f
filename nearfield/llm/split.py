"""Splitting oversized texts at natural boundaries.

Sizes are prefix sums over the text's units (code points, or tokens of a given tokenizer); the boundaries of each kind are
sorted arrays. A cut is the last boundary under the limit, found by binary search: of the best kind that has one in the
second half of the piece, else of the best kind that has one at all, else the limit itself, moved back to the start of the
grapheme there. The next piece steps back by the overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import column

KINDS = (
    ("paragraph", regex.compile(r"(?:\r\n|[\n\r\u0085  ])[^\S\n\r\u0085  ]*(?:\r\n|[\n\r\u0085  ])\s*")),
    ("line", regex.compile(r"\r\n|[\n\r\u0085  ]")),
    ("sentence", regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡]+[」』”’）]*")),
    ("word", regex.compile(r"\s+|[、，；：]")),
)
GRAPHEME = regex.compile(r"\X")
PIECES = "piece_no int, start int, end int, overlap int, size int, cut string, piece string"


@dataclass
class Piece:
    start: int
    end: int
    overlap: int
    size: int
    cut: str


def char_sizes(text: str) -> np.ndarray:
    """Prefix sums with every code point counting 1."""
    return np.arange(len(text) + 1)


def token_sizes(tokenizer) -> Callable[[str], np.ndarray]:
    """Prefix sums that count a token of a `tokenizers` tokenizer at its first code point."""

    def sizes(text: str) -> np.ndarray:
        starts = np.zeros(len(text) + 1, np.int64)
        np.add.at(starts, [s for s, _ in tokenizer.encode(text, add_special_tokens=False).offsets], 1)
        return np.append(0, np.cumsum(starts[:-1]))

    return sizes


def _snap(text: str, at: int) -> int:
    """at, moved back to the start of the grapheme that it would cut; a grapheme longer than 64 is cut."""
    if 0 < at < len(text):
        base = max(0, at - 64)
        for m in GRAPHEME.finditer(text, base, min(len(text), at + 64)):
            if m.start() <= at < m.end():
                return m.start() if m.start() > base else at
    return at


def split_text(text: str, limit: int, overlap: int, sizes: Callable[[str], np.ndarray] = char_sizes) -> list[Piece]:
    """Pieces of at most `limit`; a piece begins `overlap` before the end of the last one, or up to a grapheme earlier.

    Text of at most `limit`, empty text included, is one piece. The pieces without their overlaps join to the text. With
    token sizes a single token larger than nothing else still fits: the limit counts whole tokens.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    pre = sizes(text)
    if pre[-1] <= limit:
        return [Piece(0, len(text), 0, int(pre[-1]), "end")]
    ends = [(kind, np.array([m.end() for m in pat.finditer(text)], np.int64)) for kind, pat in KINDS]
    pieces: list[Piece] = []
    start = last = 0
    while True:
        most = int(np.searchsorted(pre, pre[start] + limit, "right")) - 1
        if most >= len(text):
            pieces.append(Piece(start, len(text), last - start, int(pre[-1] - pre[start]), "end"))
            return pieces
        # a cut must leave more than the overlap, or the next piece would not get further
        least = int(np.searchsorted(pre, max(pre[start] + overlap, pre[last]), "right"))
        half = max(least, int(np.searchsorted(pre, pre[start] + limit // 2)))
        cut = None
        for low in (half, least):
            for kind, at in ends:
                i = int(np.searchsorted(at, most, "right")) - 1
                if i >= 0 and at[i] >= low:
                    cut = (int(at[i]), kind)
                    break
            if cut:
                break
        if not cut:
            at = _snap(text, most)
            cut = (at if at >= least else max(most, least), "hard")
        end = cut[0]
        pieces.append(Piece(start, end, last - start, int(pre[end] - pre[start]), cut[1]))
        back = int(np.searchsorted(pre, pre[end] - overlap, "right")) - 1 if overlap else end
        snapped = _snap(text, back)
        # a grapheme as long as the piece is the one case in which stepping back would not advance
        start, last = (snapped if snapped > start else max(back, start + 1)), end


def split_elements(requests: DataFrame, limit: int = 2_000, overlap: int = 200, tokenizer_path: str | None = None, only_split: bool = True) -> DataFrame:
    """request_id, text_pos and the pieces of each element of `texts`, whole texts included unless only_split.

    requests: request_id, texts; other columns are ignored. A row repeated with equal texts gives its pieces once. Null
    arrays, empty arrays and null elements give no row; text_pos counts them. tokenizer_path: sizes in tokens of that
    `tokenizers` file instead of code points. Each element is a row of its own, so a long array spreads over tasks.
    """
    rows = requests.select("request_id", F.posexplode("texts").alias("text_pos", "text")).filter(F.col("text").isNotNull())
    if tokenizer_path is None and only_split:
        rows = rows.filter(F.char_length("text") > limit)
    rows = rows.distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = char_sizes
        if tokenizer_path:
            from nearfield.llm.tokens import load

            sizes = token_sizes(load(tokenizer_path))
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                owner, found, piece = [], [], []
                for i, t in enumerate(column(part, "text").to_pylist()):
                    cuts = split_text(t, limit, overlap, sizes)
                    if len(cuts) > 1 or not only_split:
                        owner += [i] * len(cuts)
                        found += [(n, p.start, p.end, p.overlap, p.size, p.cut) for n, p in enumerate(cuts)]
                        piece += [t[p.start : p.end] for p in cuts]
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([column(part, "request_id").take(at), column(part, "text_pos").take(at), *(pa.array(c, pa.int32()) for c in cols[:5]), pa.array(cols[5], pa.string()), pa.array(piece, pa.string())], ["request_id", "text_pos", "piece_no", "start", "end", "overlap", "size", "cut", "piece"])

    return rows.mapInArrow(run, "request_id long, text_pos int, " + PIECES)
