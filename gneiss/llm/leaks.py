"""Evaluation passages inside a training corpus.

Texts are reduced to lower-case words with single spaces. Let ``n`` be the length of a passage's shortest run of ``min_words`` words. A stretch that holds such a run with at most ``e``
changed characters shares at least ``n + 1 - q - q * e`` character q-grams with it on neighbouring diagonals (the q-gram lemma). So

1. a bitmap of the q-grams of all passages goes to all tasks, and one scan of the corpus keeps the regions dense enough in them for the weakest bound of all passages,
2. the different regions are joined with the passages on seeds: of every ``n`` characters of a passage its ``q * e + q`` rarest q-grams, of which a region within the bound has at least ``q``,
3. for each pair the shared q-grams are counted in overlapping bands of diagonals, bands within the bound are aligned, and the alignment decides; the words in common one after another
   are counted exactly.

The work grows with the corpus and with what matches, not with corpus times passages, and no passage or region goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.codes import code_points, mix, prefix_hash, window_hash
from gneiss.tables import cut_lineage

_CHUNK = 1 << 19
#: The bitmap has at most 2**28 bits (32 MB). Where passages fill it, more regions pass the scan, and none is lost.
_LEAST_BITS, _MOST_BITS, _BLOCK = 20, 28, 16
_HALF_BAND = 8
_JOIN = np.uint32(1)
_SPACE = np.uint32(32)
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter or digit, or a space."""
    if not _TABLE:
        t = np.full(0x110000, _SPACE, dtype=np.uint32)
        for a, b in ((0, 0xD800), (0xE000, 0x32000)):
            chars = [chr(i) for i in range(a, b)]
            t[a:b] = [ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else ord(c) if c.isalnum() else 32 for c in chars]
        _TABLE.append(t)
    return _TABLE[0]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts with single spaces as code points, texts separated by a code of their own, and where each text begins."""
    joined = code_points("\x01".join(texts))
    x = _letters()[joined]
    ends = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
    x[ends] = _JOIN
    blank = x == _SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.cumsum(keep) - keep
    return x[keep], np.r_[0, place[ends] + 1]


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "replace")


def _budget(run: int, q: int, max_edits: int) -> int:
    """The edits for which at least half of the q-grams of ``run`` characters stay, up to ``max_edits``."""
    total = run + 1 - q
    return max(e for e in range(max_edits + 1) if e == 0 or 2 * (total - q * e) >= total)


def _passage_reader(q: int, min_words: int, max_edits: int):
    schema = pa.schema([("id", pa.string()), ("passage", pa.int32()), ("words", pa.string()), ("run", pa.int32()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for case, no, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = _text(normalised([text])[0]).split()
                if len(words) >= min_words:
                    size = np.r_[0, np.cumsum([len(w) + 1 for w in words])]
                    n = int((size[min_words:] - size[:-min_words]).min()) - 1
                    rows.append((case, no, " ".join(words), n, _budget(n, q, max_edits)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _grams(q: int, named: bool):
    """The q-grams of texts: their hashes and, where ``named``, the text's key and their place. Columns: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                row, h, place = [], [], []
                for i, t in enumerate(texts[a : a + 256], a):
                    x = window_hash(prefix_hash(code_points(t)), q) if len(t) >= q else np.empty(0, np.uint64)
                    row.append(np.full(len(x), i))
                    h.append(x.view(np.int64))
                    place.append(np.arange(len(x), dtype=np.int32))
                h = pa.array(np.concatenate(h))
                if named:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(place)), h], ["key", "place", "h"])
                else:
                    yield pa.RecordBatch.from_arrays([h], ["h"])

    return run


def _bitmap(grams: DataFrame, bits: int) -> bytes:
    """A bit for each value of the upper ``bits`` bits of the hashes; at most 32 MB, made in blocks on Spark."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << _BLOCK, dtype=bool)
        block[pdf["slot"].to_numpy() & ((1 << _BLOCK) - 1)] = True
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [np.packbits(block).tobytes()]})

    slot = F.shiftrightunsigned("h", 64 - bits)
    blocks = grams.select(slot.alias("slot")).distinct().withColumn("block", F.shiftright("slot", _BLOCK)).groupBy("block").applyInPandas(pack, "block long, bits binary")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    step = 1 << (_BLOCK - 3)
    for r in blocks.toLocalIterator():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _scan(bitmap, bits: int, q: int, near: int, need: int, margin: int):
    """Regions of texts where ``near`` places one after another hold ``need`` q-grams of the bitmap, with ``margin`` characters around, grown to whole words."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("region", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            group: list[int] = []
            size = 0
            for i, t in enumerate([*texts, None]):
                if t:
                    group.append(i)
                    size += len(t)
                if group and (size > _CHUNK or i == len(texts)):
                    rows = look(held, [texts[g] for g in group], [ids[g] for g in group])
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    group, size = [], 0

    def look(held: np.ndarray, texts: list[str], ids: list[int]) -> list[tuple]:
        x, starts = normalised(texts)
        if len(x) < q:
            return []
        slot = window_hash(prefix_hash(x), q) >> np.uint64(64 - bits)
        hit = (held[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1
        seen = np.r_[0, np.cumsum(hit, dtype=np.int64)]
        at = np.arange(len(hit))
        dense = np.flatnonzero((seen[np.minimum(at + near, len(hit))] - seen[:-1] >= need) & (hit == 1))
        if not len(dense):
            return []
        text = np.searchsorted(starts, dense, side="right") - 1
        end = np.r_[starts[1:] - 1, len(x)][text]
        left = np.maximum(starts[text], dense - margin)
        right = np.minimum(end, dense + near + q - 1 + margin)
        reach = np.maximum.accumulate(right)
        first = np.flatnonzero(np.r_[True, (left[1:] > reach[:-1]) | (text[1:] != text[:-1])])
        rows = []
        for a, b in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(left) - 1]):
            lo, hi, begin, stop = int(left[a]), int(reach[b]), int(starts[text[a]]), int(end[a])
            while lo > begin and x[lo - 1] > 32:
                lo -= 1
            while hi < stop and x[hi] > 32:
                hi += 1
            rows.append((ids[text[a]], lo - begin, _text(x[lo:hi])))
        return rows

    return run


def _seeds(q: int, spare: int):
    """Of every stretch of ``run`` characters of a passage the ``q * edits + spare`` rarest q-grams, and how many different ones of them a region within the bound has at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, least = [], [], []
            for p, n, e, grams in zip(*(batch.column(i).to_pylist() for i in range(4))):
                grams.sort(key=lambda g: g["place"])
                h = np.array([g["h"] for g in grams], dtype=np.int64)
                different, first, of = np.unique(h, return_index=True, return_inverse=True)
                order = np.argsort(np.array([g["n"] for g in grams])[first], kind="stable")
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                wide, few = min(n + 1 - q, len(h)), q * e + spare
                windows = np.lib.stride_tricks.sliding_window_view(rank[of], wide)
                kept, shared = np.zeros(len(order), dtype=bool), wide
                for a in range(0, len(windows), 4096):
                    best = np.sort(windows[a : a + 4096], axis=1)[:, :few]
                    kept[best.ravel()] = True
                    shared = min(shared, int((np.diff(best, axis=1) != 0).sum(axis=1).min()) + 1 - q * e)
                chosen = different[order[kept]]
                keys += [p] * len(chosen)
                least += [max(1, shared)] * len(chosen)
                out.append(chosen)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(out)), pa.array(least, pa.int32())], ["p", "h", "least"])

    return run


def bands(x: np.ndarray, starts: np.ndarray, codes: list[np.ndarray], need: np.ndarray, near: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair and first diagonal (in ``x``) of each band that holds ``need`` q-grams shared by region and passage within ``near`` places. Pair ``i`` is the region from ``starts[i]`` and ``codes[i]``."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(x) < q:
        return none
    own = mix(np.arange(1, len(codes) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    pair = np.searchsorted(starts, np.arange(len(x) - q + 1), side="right") - 1
    h = window_hash(prefix_hash(x), q) ^ own[pair]
    parts = [window_hash(prefix_hash(c), q) for c in codes]
    lengths = np.array([len(c) for c in parts])
    owner = np.repeat(np.arange(len(codes)), lengths)
    g = np.concatenate(parts) ^ own[owner]
    place = np.arange(len(g)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(g, kind="stable")
    g, place = g[order], place[order]
    low = np.searchsorted(g, h, side="left")
    n = np.searchsorted(g, h, side="right") - low
    at = np.flatnonzero(n)
    low, n = low[at], n[at]
    if not len(at):
        return none
    post = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    # diagonals are made positive; every one lies in two bands
    lead = -(-max(map(len, codes)) // _HALF_BAND) * _HALF_BAND + _HALF_BAND
    band = (at - place[post] + lead) // _HALF_BAND
    key = np.r_[(pair[at] << 40) | band, (pair[at] << 40) | (band - 1)]
    at = np.r_[at, at]
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    who = key >> 40
    last = np.arange(len(key)) + need[who] - 1
    ok = last < len(key)
    last = np.minimum(last, len(key) - 1)
    ok &= (key[last] == key) & (at[last] - at <= near[who])
    key = np.unique(key[ok])
    return key >> 40, (key & ((1 << 40) - 1)) * _HALF_BAND - lead


def align(x: np.ndarray, codes: list[np.ndarray], diagonal: np.ndarray, max_edits: int) -> np.ndarray:
    """The best local alignment of each passage in ``codes`` inside its band of ``x``: columns score, edits, first and last place of the passage, first and last in ``x``."""
    pad, width = 2 * _HALF_BAND, 2 * _HALF_BAND + 2 * max_edits
    longest = max(map(len, codes))
    y = np.zeros((len(codes), longest), dtype=np.uint32)
    for i, c in enumerate(codes):
        y[i, : len(c)] = c
    base = diagonal - max_edits
    n = len(codes)
    score = np.zeros((n, width + 1), dtype=np.int32)
    edits = np.zeros_like(score)
    begin_y = np.zeros_like(score)
    begin_x = np.zeros((n, width + 1), dtype=np.int64)
    best = np.zeros((n, 6), dtype=np.int64)
    lane = np.arange(width)
    wide = np.concatenate([np.zeros(pad, np.uint32), x, np.zeros(pad, np.uint32)])
    for i in range(longest):
        j = base[:, None] + i + lane
        inside = (j >= 0) & (j < len(x))
        c = wide[np.clip(j + pad, 0, len(wide) - 1)]
        same = inside & (c == y[:, i : i + 1]) & (c > 1)
        old, e0, by, bx = score[:, :width], edits[:, :width], begin_y[:, :width], begin_x[:, :width]
        fresh = old <= 0
        by = np.where(fresh, i, by)
        bx = np.where(fresh, j, bx)
        e = np.where(fresh, 0, e0) + ~same
        s = np.where(fresh, 0, old) + np.where(same, 1, -2)
        s[(c == _JOIN) | ~inside] = -1
        up = score[:, 1:] - 2
        take = up > s
        s, e, by, bx = np.where(take, up, s), np.where(take, edits[:, 1:] + 1, e), np.where(take, begin_y[:, 1:], by), np.where(take, begin_x[:, 1:], bx)
        for _ in range(max_edits):
            side = s[:, :-1] - 2
            take = side > s[:, 1:]
            if not take.any():
                break
            s[:, 1:] = np.where(take, side, s[:, 1:])
            e[:, 1:] = np.where(take, e[:, :-1] + 1, e[:, 1:])
            by[:, 1:] = np.where(take, by[:, :-1], by[:, 1:])
            bx[:, 1:] = np.where(take, bx[:, :-1], bx[:, 1:])
        score[:, :width], edits[:, :width], begin_y[:, :width], begin_x[:, :width] = s, e, by, bx
        top = np.argmax(s, axis=1)
        r = np.arange(n)
        now = s[r, top]
        better = now > best[:, 0]
        best[better] = np.stack([now, e[r, top], by[r, top], np.full(n, i), bx[r, top], j[r, top]], axis=1)[better]
    return best


def common_words(region: str, passage: str, least: int) -> int:
    """The longest run of words, of at least ``least``, that both hold; 0 if there is none."""
    words, own = region.split(), passage.split()
    grams = {" ".join(own[i : i + least]) for i in range(len(own) - least + 1)}
    mine = f" {passage} "
    best, i = 0, 0
    while i <= len(words) - least:
        if " ".join(words[i : i + least]) in grams:
            run = least
            while i + run < len(words) and f" {' '.join(words[i : i + run + 1])} " in mine:
                run += 1
            best = max(best, run)
        i += 1
    return best


_PAIRS = pa.schema([("r", pa.binary()), ("p", pa.binary()), ("common_words", pa.int32()), ("score", pa.int32()), ("aligned_chars", pa.int32()), ("edits", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def _verify(q: int, min_words: int, max_edits: int):
    """Aligns pairs of a region and a passage. Columns: r, region, p, words, run, edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            rows.sort(key=lambda r: len(r[3]))
            at = 0
            while at < len(rows):
                # pairs of like length together, so that their table of letters stays small
                to, size = at, 0
                while to < len(rows) and to - at < 1024 and (to == at or size + len(rows[to][1]) <= _CHUNK and len(rows[to][3]) * (to - at) <= 1 << 21):
                    size += len(rows[to][1])
                    to += 1
                out = look(rows[at:to])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PAIRS)], schema=_PAIRS)
                at = to

    def look(rows: list[tuple]) -> list[tuple]:
        x = code_points("\x01".join(r[1] for r in rows))
        starts = np.cumsum([0] + [len(r[1]) + 1 for r in rows[:-1]])
        codes = [code_points(r[3]) for r in rows]
        run, budget = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        need = np.maximum(1, run + 1 - q - q * budget)
        pair, diagonal = bands(x, starts, codes, need, run - q + max_edits, q)
        best: dict[int, tuple] = {}
        for a in range(0, len(pair), 512):
            k = pair[a : a + 512].tolist()
            for i, (score, edits, y0, y1, x0, x1) in zip(k, align(x, [codes[i] for i in k], diagonal[a : a + 512], max_edits).tolist()):
                # an alignment that holds a run with no more edits than its budget scores at least this
                if score >= rows[i][4] - 3 * rows[i][5] and (i not in best or score > best[i][0]):
                    best[i] = (score, y1 - y0 + 1, edits, x0 - int(starts[i]), x1 + 1 - int(starts[i]))
        return [(rows[i][0], rows[i][2], common_words(rows[i][1], rows[i][3], min_words), *b) for i, b in best.items()]

    return run


def leaked_passages(docs: DataFrame, cases: DataFrame, min_words: int = 12, max_edits: int = 2, q: int = 8) -> DataFrame:
    """Documents that hold passages of evaluation cases, one row for each document, case and passage.

    ``docs``: doc_id, text. ``cases``: id, expected (array of structs with ``quote``). Columns of the result: ``common_words``, the longest run of words in common
    (0 under ``min_words``); ``aligned_chars`` and ``edits`` of the best alignment; ``start``, ``stop`` of it in the document's words joined by single spaces.

    A row stands for an alignment that scores (1 a character, -2 an edit) as much as the passage's shortest run of ``min_words`` words within its budget of edits: ``max_edits``, or fewer
    where they would leave less than half of the run's q-grams. Every region that keeps to the bound of the q-gram lemma is aligned, so no run of ``min_words`` words is lost. NULL quotes
    and quotes of fewer words have no row, nor do NULL and empty texts; repeated rows count once. The corpus is scanned once, however many passages there are.
    """
    if q > 2 * min_words - 1:
        raise ValueError("q is longer than the shortest run")
    spark = docs.sparkSession
    quotes = cases.select("id", F.posexplode("expected").alias("passage", "e")).select("id", "passage", F.col("e.quote").alias("quote")).filter("id is not null and quote is not null").distinct()
    key = F.unhex(F.md5("words")).alias("p")
    named = cut_lineage(quotes.mapInArrow(_passage_reader(q, min_words, max_edits), "id string, passage int, words string, run int, edits int").select("id", "passage", "words", "run", "edits", key))
    passages = named.select("p", "words", "run", "edits").distinct()
    shortest, longest, size = passages.agg(F.min("run"), F.max("run"), F.sum(F.length("words"))).first()
    if not size:
        return spark.createDataFrame([], "doc_id long, id string, passage int, common_words int, aligned_chars int, edits int, start int, stop int")
    # of the parts as long as the shortest run that a passage's own run has, one holds no more than its share of the edits
    spent = F.floor(F.col("edits") / F.floor(F.col("run") / shortest))
    need = max(1, shortest + 1 - q - q * passages.agg(F.max(spent)).first()[0])
    bits = min(_MOST_BITS, max(_LEAST_BITS, math.ceil(math.log2(16 * size))))
    grams = passages.select("p", "words").mapInArrow(_grams(q, True), "key binary, place int, h long")
    bitmap = spark.sparkContext.broadcast(_bitmap(grams, bits))
    scan = _scan(bitmap, bits, q, shortest + 1 - q + max_edits, need, longest + 2 * _HALF_BAND)
    regions = cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, start int, region string").withColumn("r", F.unhex(F.md5("region"))))
    different = regions.select("r", "region").distinct()

    counts = grams.select("key", "h").distinct().groupBy("h").agg(F.count("*").alias("n"))
    listed = grams.join(counts, "h").groupBy("key").agg(F.collect_list(F.struct("place", "h", "n")).alias("grams"))  # a passage's own q-grams
    seeds = listed.join(passages, listed["key"] == passages["p"]).select("p", "run", "edits", "grams").mapInArrow(_seeds(q, q), "p binary, h long, least int")
    held = different.select("r", "region").mapInArrow(_grams(q, True), "key binary, place int, h long").select(F.col("key").alias("r"), "h").distinct()
    pairs = held.join(seeds, "h").groupBy("r", "p").agg(F.count("*").alias("n"), F.min("least").alias("least")).filter("n >= least").select("r", "p")
    # alignments take long for their size, so the number of tasks is not left to sizes
    pairs = pairs.join(different, "r").join(passages, "p").select("r", "region", "p", "words", "run", "edits").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "r", "p")
    found = pairs.mapInArrow(_verify(q, min_words, max_edits), "r binary, p binary, common_words int, score int, aligned_chars int, edits int, first int, last int")
    placed = found.join(named.select("p", "id", "passage"), "p").join(regions.select("r", "doc_id", "start"), "r")
    start, stop = F.col("start") + F.col("first"), F.col("start") + F.col("last")
    best = F.max(F.struct("common_words", "score", (-start).alias("before"), "aligned_chars", "edits", start.alias("start"), stop.alias("stop"))).alias("b")
    return placed.groupBy("doc_id", "id", "passage").agg(best).select("doc_id", "id", "passage", *[f"b.{c}" for c in ("common_words", "aligned_chars", "edits", "start", "stop")])


def leaked_documents(docs: DataFrame, cases: DataFrame, min_words: int = 12) -> DataFrame:
    """Distinct ``(doc_id, id)`` of documents with a passage of a case by its alignment, in which at least ``min_words`` consecutive words are the same."""
    return leaked_passages(docs, cases, min_words).filter(F.col("common_words") >= min_words).select("doc_id", "id").distinct()
