"""Cutting oversized records into pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.codes import code_points

#: Marks that end a sentence, alone in Chinese or before white space elsewhere, and marks after which Chinese text may break.
SENTENCE_END = ".!?…"
WIDE_END = "。！？；"
WIDE_BREAK = "，、：）》」』"
CUTS = ("paragraph", "line", "sentence", "word", "hard")


class Offsets:
    """Prefix sums of a text's tokens and, as sorted arrays, the places where a piece may end, from the strongest kind (paragraph) to the weakest (word).

    ``sums`` gives for each place how many characters stand before it where ``\\r\\n`` reads as one break. A paragraph is a run of lines that hold more than spaces and tabs;
    ``first`` and ``last`` are where paragraphs begin and end in the text as stored.
    """

    def __init__(self, text: str):
        c = code_points(text)
        n = len(c)
        breaks = c == 10
        pairs = (c == 13) & np.r_[breaks[1:], False]
        self.sums = np.arange(n + 1) - np.r_[0, np.cumsum(pairs)]
        ink = np.r_[0, np.cumsum(~(breaks | pairs | (c == 32) | (c == 9)))]
        line_end = np.r_[np.flatnonzero(breaks), n]
        line = np.r_[0, line_end[:-1] + 1]
        full = ink[line_end] > ink[line]
        opens, closes = full & ~np.r_[False, full[:-1]], full & ~np.r_[full[1:], False]
        self.first = line[opens]
        self.last = line_end[closes] - np.r_[pairs, False][line_end[closes] - 1]
        blank = np.isin(c, code_points(" \t\n\r\u00a0\u3000\u2009"))
        words = np.flatnonzero(~blank & np.r_[False, blank[:-1]])
        # the character before the white space before a word tells whether a sentence ends there
        lead = np.maximum.accumulate(np.where(blank, -1, np.arange(n))) if n else np.empty(0, int)
        spoken = lead[words - 1] if len(words) else words
        ends = words[(spoken >= 0) & np.isin(c[np.maximum(spoken, 0)], code_points(SENTENCE_END))] if n else words
        wide = np.flatnonzero(np.isin(c, code_points(WIDE_END))) + 1
        soft = np.flatnonzero(np.isin(c, code_points(WIDE_BREAK + WIDE_END))) + 1
        self.places = [self.first[1:], line_end[:-1] + 1, np.unique(np.r_[ends, wide]), np.unique(np.r_[words, soft])]

    def oversized(self, limit: int) -> np.ndarray:
        """Numbers, from 0, of paragraphs that must be cut inside: the last boundary within ``limit`` characters of their start, by binary search, comes before their end."""
        ends = self.sums[self.last]
        return np.flatnonzero(np.searchsorted(ends, self.sums[self.first] + limit, side="right") <= np.arange(len(ends)))


def pieces(text: str, limit: int, overlap: int, offsets: Offsets | None = None) -> list[tuple[int, int, str]]:
    """``(start, stop, cut)`` of pieces of at most ``limit`` characters; each begins ``overlap`` characters before the last one ended.

    A piece ends at the strongest kind of boundary that lies in its second half; else at the last boundary of any kind that still
    goes forward; else after ``limit`` characters, though never inside ``\\r\\n``. ``cut`` names the kind, ``end`` for the last piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    places = (offsets or Offsets(text)).places
    out, start = [], 0
    while n - start > limit:
        stop, cut = 0, ""
        for least in (start + max(limit // 2, overlap), start + overlap):
            for kind, at in zip(CUTS, places):
                i = int(np.searchsorted(at, start + limit, side="right")) - 1
                if i >= 0 and at[i] > least:
                    stop, cut = int(at[i]), kind
                    break
            if stop:
                break
        if not stop:
            stop, cut = start + limit, "hard"
            if text[stop - 1 : stop + 1] == "\r\n" and stop - 1 > start + overlap:
                stop -= 1
        out.append((start, stop, cut))
        start = stop - overlap
    return [*out, (start, n, "end")]


_PIECES = pa.schema([("table_name", pa.string()), ("record_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("cut", pa.string()), ("text", pa.string()), ("oversized_blocks", pa.list_(pa.int32()))])


def _cutter(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, record, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                offsets = Offsets(text)
                found = pieces(text, limit, overlap, offsets)
                large = offsets.oversized(limit)
                # each goes with the first piece that holds a part of it
                of = np.searchsorted([p[1] for p in found], offsets.first[large], side="right").tolist()
                blocks: dict[int, list[int]] = {}
                for piece, block in zip(of, large.tolist()):
                    blocks.setdefault(piece, []).append(block + 1)
                for no, (start, stop, cut) in enumerate(found):
                    rows.append((name, record, no + 1, start, stop, cut, text[start:stop] if with_text else None, blocks.get(no, [])))
                if len(rows) >= 4096:
                    yield to_batch(rows)
                    rows = []
            if rows:
                yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return run


def split_records(records: DataFrame, limit: int = 1500, overlap: int = 150, all_records: bool = False, with_text: bool = True) -> DataFrame:
    """Numbered pieces of every record longer than ``limit`` characters.

    ``records``: table_name, record_id, text; other columns are ignored. Result: ``piece_no`` from 1, ``start`` and ``stop`` in the text as stored,
    ``cut`` (the kind of boundary at its end), ``text``, and ``oversized_blocks``: the numbers of those paragraphs that begin in the piece (not in one before) and have no boundary of
    paragraphs within ``limit`` characters, so that the splitter must cut inside. Dropping the first ``overlap`` characters of all pieces but the first and joining them gives the record's text.

    NULL and empty texts have no piece. Shorter records come as one piece where ``all_records`` is set, else not at all. Exact duplicate
    rows give their pieces once for each row; ``oversized_paragraphs`` counts them once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    r = records.select("table_name", F.col("record_id").cast("long"), "text")
    r = r.filter(F.length("text") > (0 if all_records else limit))
    kind = "table_name string, record_id long, piece_no int, start int, stop int, cut string, text string, oversized_blocks array<int>"
    return r.mapInArrow(_cutter(limit, overlap, with_text), kind)


def oversized_paragraphs(records: DataFrame, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Distinct ``(table_name, record_id, block_no)`` of paragraphs longer than ``limit``, which the splitter had to cut inside."""
    p = split_records(records, limit, overlap, with_text=False)
    return p.select("table_name", "record_id", F.explode("oversized_blocks").alias("block_no")).distinct()
