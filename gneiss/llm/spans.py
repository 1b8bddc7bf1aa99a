"""Long exact spans shared between records.

Two records that share ``min_len`` characters share the *anchor* of that stretch: of the windows of ``min_len // 2`` characters
inside it, the one with the least hash. Anchors are about one window in seventy-six, so they can be counted:

1. every partition counts its anchors in a sparse count-min sketch of two rows; the partial sketches are merged block by block. The width follows the
   number of anchors without an end, so a cell holds a quarter of an anchor on average at every size, and the sketch stays distributed,
2. a second pass keeps only anchors whose cells both count at least two. The sketch overestimates, so none is lost,
3. the kept anchors are counted exactly, and those of two or more records are grouped and compared character by character.

An anchor that really stands at more than ``hot`` places never becomes one group. Places with the same text around them are one class, told apart by an aggregate with partial
sums, and only classes are compared, by the windows of ``min_len`` characters that they hold; so text which a third of all records carry costs a row for each place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.codes import code_points, mix, prefix_hash, segments, sliding_min, window_hash
from gneiss.tables import cut_lineage

_SEGMENT = 1 << 19
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a place inside a segment, which holds less than twice ``_SEGMENT`` characters.
_PLACE = np.uint64(20)
#: A block of the sketch has at least 2**16 cells, and there are at most 2**18 blocks a row, so a group holds tens of megabytes at 10**12 anchors.
_BLOCK, _BLOCKS = 16, 18
#: Places of one hot class that one task of a join takes.
_SALT = 1 << 16


def _anchors(codes: np.ndarray, parts: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions in ``codes`` and their hashes."""
    none = np.empty(0, dtype=np.int64)
    if len(codes) < min_len:
        return none, none.astype(np.uint64)
    width = min_len // 2
    h = window_hash(prefix_hash(codes), width)
    # the hash's upper bits and the place, so that the least value names the leftmost of the least; the number of bits is fixed, so all segments choose alike
    packed = ((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(packed, min_len - width + 1)
    inside = np.zeros(len(least) + 1, dtype=np.int32)
    whole = parts[parts[:, 3] - parts[:, 2] >= min_len]
    np.add.at(inside, whole[:, 2], 1)
    np.add.at(inside, whole[:, 3] - min_len + 1, -1)
    at = (least[np.cumsum(inside[:-1]) > 0] & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    places = np.unique(at[np.r_[True, at[1:] != at[:-1]]]) if len(at) else at
    # the least of many hashes has upper bits near 0, so it is mixed once more to fill the sketch evenly
    return places, mix(h[places] * _SEED)


def _extractor(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for parts, codes, _ in segments(batch.column(1).to_pylist(), _SEGMENT, min_len - 1):
                at, h = _anchors(codes, parts, min_len)
                if not len(at):
                    continue
                part = np.searchsorted(parts[:, 2], at, side="right") - 1
                pos = at - parts[part, 2] + parts[part, 1]
                used, first = np.unique(part, return_index=True)
                cut = pa.array(np.r_[first, len(at)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids[parts[used, 0]]), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(pos.astype(np.int32)))], ["doc_id", "hashes", "places"])

    return run


def anchor_lists(docs: DataFrame, min_len: int) -> DataFrame:
    """``(doc_id, hashes, places)``: the anchors of each text, of a long text in several rows. ``docs``: doc_id, text. It is written once, in twelve bytes an anchor."""
    d = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").filter(F.length("text") >= min_len)
    return cut_lineage(d.mapInArrow(_extractor(min_len), "doc_id long, hashes array<long>, places array<int>"))


def _sketcher(k: int, block: int):
    """Sparse sketches of a partition: for each row and block the cells that are not 0, with their counts up to 255."""
    low_type = "<u2" if block <= 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            rows, blocks, data = [], [], []
            for row, cell in enumerate((h >> np.uint64(64 - k), h & np.uint64((1 << k) - 1))):
                order = np.argsort(cell, kind="stable")
                c, m = cell[order], n[order]
                first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                m = np.minimum(np.add.reduceat(m, first), 255).astype(np.uint8)
                c = c[first]
                of = (c >> np.uint64(block)).astype(np.int64)
                low = (c & np.uint64((1 << block) - 1)).astype(low_type)
                cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(c)]):
                    rows.append(row)
                    blocks.append(int(of[a]))
                    data.append(low[a:b].tobytes() + m[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], ["row", "block", "cells"])

        for batch in batches:
            h = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(h)
            seen += len(h)
            if seen > 1 << 21:
                yield from flush()
                held, seen = [], 0
        if seen:
            yield from flush()

    return run


def _merger(block: int):
    """Adds up the partial sketches of one block and gives the cells that count two or more."""
    import pandas as pd

    low_type = np.dtype("<u2" if block <= 16 else "<u4")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << block, dtype=np.uint8)
        for cells in pdf["cells"]:
            n = len(cells) // (low_type.itemsize + 1)
            low = np.frombuffer(cells, low_type, n)
            total[low] = np.minimum(total[low].astype(np.uint16) + np.frombuffer(cells, np.uint8, n, low_type.itemsize * n), 255)
        cell = (int(pdf["block"].iloc[0]) << block) + np.flatnonzero(total >= 2)
        return pd.DataFrame({"row": np.full(len(cell), pdf["row"].iloc[0], np.int32), "cell": cell})

    return run


def repeated_cells(anchors: DataFrame, k: int) -> DataFrame:
    """``(row, cell)`` of the merged count-min sketch with 2**k cells a row: cells that count at least two anchors. ``anchors``: hashes.

    The cell of an anchor is the upper ``k`` bits of its hash in row 0 and the lower ``k`` bits in row 1.
    """
    block = max(min(_BLOCK, k), k - _BLOCKS)
    parts = anchors.select("hashes").mapInArrow(_sketcher(k, block), "row int, block long, cells binary")
    return parts.groupBy("row", "block").applyInPandas(_merger(block), "row int, cell long")


def repeated_anchors(docs: DataFrame, min_len: int, hot: int, k: int | None = None) -> DataFrame:
    """``(hot, anchor, doc_id, pos, off, ctx)``: places of anchors that two or more records have, with the text around them.

    ``hot`` marks anchors at more than ``hot`` places. ``k`` is the width of the sketch in bits, by default that of four cells an anchor; with fewer cells more anchors pass the sketch, and the
    exact count after it leaves the same ones.
    """
    lists = anchor_lists(docs, min_len)
    if k is None:
        n = lists.agg(F.sum(F.size("hashes"))).first()[0] or 0
        k = min(62, max(_BLOCK, math.ceil(math.log2(4 * n + 1))))
    cells = cut_lineage(repeated_cells(lists, k))
    each = lists.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("doc_id", F.col("a.hashes").alias("anchor"), F.col("a.places").alias("pos"))
    for row, cell in enumerate((F.shiftrightunsigned("anchor", 64 - k), F.col("anchor").bitwiseAND(F.lit((1 << k) - 1)))):
        kept = cells.filter(F.col("row") == row).select("cell")
        each = each.withColumn("cell", cell).join(kept, "cell", "left_semi").drop("cell")
    each = cut_lineage(each)
    exact = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low <> high")
    exact = exact.select("anchor", (F.col("n") > hot).alias("hot"))
    # a text has a bounded number of anchors, so its list is one row
    wanted = cut_lineage(each.join(exact, "anchor").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("pos", "anchor", "hot"))).alias("wanted")))
    # where the ids alone are few, Spark sends them to the texts, and no other text is shuffled
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select("doc_id"), "doc_id", "left_semi").join(wanted, "doc_id")
    return cut_lineage(texts.mapInArrow(_surroundings(min_len), "hot boolean, anchor long, doc_id long, pos int, off int, ctx string"))


def _surroundings(min_len: int):
    width = min_len // 2
    reach = min_len - width
    schema = pa.schema([("hot", pa.bool_()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("off", pa.int32()), ("ctx", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            at, flat = wanted.offsets.to_numpy(), wanted.values
            pos, anchor, often = (flat.field(i) for i in range(3))
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            # rows come out a few thousand at a time, as each carries hundreds of characters
            for a in range(0, len(texts), 256):
                b = min(len(texts), a + 256)
                lo, hi = int(at[a]), int(at[b])
                if lo == hi:
                    continue
                row = np.repeat(np.arange(a, b), np.diff(at[a : b + 1]))
                p = pos.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                left = np.maximum(p - reach, 0)
                ctx = [texts[r][x:y] for r, x, y in zip(row.tolist(), left.tolist(), (p + width + reach).tolist())]
                columns = [often.slice(lo, hi - lo), anchor.slice(lo, hi - lo), pa.array(ids[row]), pa.array(p), pa.array((p - left).astype(np.int32)), pa.array(ctx, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both sides of every pair inside groups of the given sizes, groups following one another."""
    first = np.cumsum(sizes) - sizes
    left, right = [], []
    for g in np.unique(sizes):
        if g < 2:
            continue
        i, j = np.triu_indices(g, 1)
        base = first[sizes == g]
        left.append((base[:, None] + i).ravel())
        right.append((base[:, None] + j).ravel())
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _matched(min_len: int, spans: bool):
    """Compares the occurrences of each anchor. Rows come sorted by anchor; a group holds at most ``hot`` of them."""
    width = min_len // 2
    reach = min_len - width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor = t.column("anchor").to_numpy()
            edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            sizes = np.diff(np.r_[edge, len(anchor)])
            a, b = _pairs_of(sizes)
            ids = t.column("doc_id").to_numpy()
            differ = ids[a] != ids[b]
            a, b = a[differ], b[differ]
            if not len(a):
                return
            used, back = np.unique(np.r_[a, b], return_inverse=True)
            ctx, off, pos = t.column("ctx").take(pa.array(used)).to_pylist(), t.column("off").to_numpy()[used], t.column("pos").to_numpy()[used]
            ids = ids[used]
            # a filler of its own for each row, so that beyond a text's end nothing is equal
            m = np.repeat(-1 - np.arange(len(used), dtype=np.int32)[:, None], width + 2 * reach, axis=1)
            for i, (c, o) in enumerate(zip(ctx, off)):
                m[i, reach - o : reach - o + len(c)] = code_points(c).view(np.int32)
            back = back.reshape(2, -1)
            for at in range(0, back.shape[1], 8192):
                x, y = back[:, at : at + 8192]
                same = m[x] == m[y]

                def run_length(s: np.ndarray) -> np.ndarray:
                    return np.where(s.all(axis=1), s.shape[1], np.argmin(s, axis=1))

                before = run_length(same[:, :reach][:, ::-1])
                after = run_length(same[:, reach + width :])
                ok = same[:, reach : reach + width].all(axis=1) & (before + width + after >= min_len)
                x, y, before, after = x[ok], y[ok], before[ok], after[ok]
                if not len(x):
                    continue
                if spans:
                    r = np.r_[x, y]
                    out = np.stack([ids[r], pos[r] - np.r_[before, before], pos[r] + width + np.r_[after, after]])
                else:
                    out = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], names)

        names = ["doc_id", "start", "stop"] if spans else ["doc_id_a", "doc_id_b"]
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < 8192:
                continue
            anchor = held.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield from compare(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield from compare(held.combine_chunks())

    return run


def _grouped(found: DataFrame) -> DataFrame:
    cold = found.filter(~F.col("hot")).select("anchor", "doc_id", "pos", "off", "ctx").distinct()
    return cold.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "pos")


def _windows(min_len: int):
    """The windows of ``min_len`` characters of each class's text that hold its anchor, as hashes with their place beside the anchor's."""
    schema = pa.schema([("anchor", pa.int64()), ("kind", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("key", pa.int64()), ("rel", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, off = batch.column(5).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False)
            for a in range(0, len(texts), 128):
                row, key, rel = [], [], []
                for i, t in enumerate(texts[a : a + 128], a):
                    h = window_hash(prefix_hash(code_points(t)), min_len).view(np.int64)
                    row.append(np.full(len(h), i))
                    key.append(h)
                    rel.append(np.arange(len(h), dtype=np.int32) - off[i])
                if row:
                    at = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(4)], pa.array(np.concatenate(key)), pa.array(np.concatenate(rel))], schema=schema)

    return run


def _classes(found: DataFrame, min_len: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of hot anchors: the places ``(anchor, kind, doc_id, pos)``, where ``kind`` names places with the same text around the anchor; the windows of each class; and those
    windows that two or more records have."""
    hot = found.filter("hot").withColumn("kind", F.md5(F.concat_ws(":", "off", "ctx")))
    places = hot.select("anchor", "kind", "doc_id", "pos").distinct()
    classes = hot.filter(F.length("ctx") >= min_len).groupBy("anchor", "kind", "off", "ctx").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    windows = cut_lineage(classes.select("anchor", "kind", "low", "high", "off", "ctx").mapInArrow(_windows(min_len), "anchor long, kind string, low long, high long, key long, rel int"))
    shared = windows.groupBy("anchor", "key").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least <> most").select("anchor", "key")
    return places, windows, shared


def shared_pairs(docs: DataFrame, min_len: int = 300, hot: int = 64, k: int | None = None) -> DataFrame:
    """Pairs ``(doc_id_a, doc_id_b)``, smaller id first, of records with at least ``min_len`` consecutive characters in common.

    ``docs`` has ``doc_id`` (unique, long) and ``text``; other columns are ignored. NULL ids, NULL, empty and shorter texts have no pair; a
    record never pairs with itself; repeated rows of one ``doc_id`` count once. Comparison is exact, by code points as stored.
    An empty table gives no rows. All pairs are written out, also those of copies, as the result is defined by them.
    """
    found = repeated_anchors(docs, min_len, hot, k)
    cold = _grouped(found).mapInArrow(_matched(min_len, False), "doc_id_a long, doc_id_b long")
    places, windows, shared = _classes(found, min_len)
    # windows that the same classes hold are one case: of each such set only one window is paired
    held = windows.select("anchor", "key", "kind").distinct().join(shared, ["anchor", "key"], "left_semi")
    sets = held.groupBy("anchor", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("kind")).alias("of"), F.min("kind").alias("first"), F.max("kind").alias("last"))
    sets = sets.groupBy("anchor", "n", "of", "first", "last").agg(F.min("key").alias("key")).select("anchor", "key")
    members = held.join(sets, ["anchor", "key"], "left_semi").join(places.select("anchor", "kind", "doc_id").distinct(), ["anchor", "kind"]).select("anchor", "key", "doc_id").distinct()
    # each side of a large set is cut, so that a task pairs at most ``_SALT`` records with one part of the other side
    salts = members.groupBy("anchor", "key").agg(F.ceil(F.count("*") / (16 * hot)).cast("int").alias("salts"))
    m = members.join(salts, ["anchor", "key"])
    a = m.select("anchor", "key", F.col("doc_id").alias("doc_id_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    b = m.select("anchor", "key", F.col("doc_id").alias("doc_id_b"), F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    warm = a.join(b, ["anchor", "key", "salt"]).filter("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return cold.union(warm).distinct()


def shared_spans(docs: DataFrame, min_len: int = 300, hot: int = 64, k: int | None = None) -> DataFrame:
    """Stretches ``(doc_id, start, stop)`` of each text that stand, ``min_len`` characters or more at a time, in another record.

    ``start`` counts code points from 0, ``stop`` is exclusive; stretches of a record neither touch nor overlap. The inputs and
    edge cases are those of ``shared_pairs``; no pairs are formed for hot text, so groups of copies cost linear work.
    """
    found = repeated_anchors(docs, min_len, hot, k)
    cold = _grouped(found).mapInArrow(_matched(min_len, True), "doc_id long, start long, stop long")
    places, windows, shared = _classes(found, min_len)
    # all windows of a class hold its anchor, so together they are one stretch
    reach = windows.join(shared, ["anchor", "key"], "left_semi").groupBy("anchor", "kind").agg(F.min("rel").alias("first"), (F.max("rel") + min_len).alias("last"))
    sized = places.groupBy("anchor", "kind").agg(F.ceil(F.count("*") / _SALT).cast("int").alias("salts"))
    reach = reach.join(sized, ["anchor", "kind"])
    spread = reach.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("anchor", "kind", "salt", "first", "last")
    salted = places.join(sized, ["anchor", "kind"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    warm = salted.join(spread, ["anchor", "kind", "salt"]).select("doc_id", (F.col("pos") + F.col("first")).cast("long").alias("start"), (F.col("pos") + F.col("last")).cast("long").alias("stop"))
    each = cold.union(warm).groupBy("doc_id", "start").agg(F.max("stop").alias("stop"))
    w = Window.partitionBy("doc_id").orderBy("start")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    run = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def shared_share(docs: DataFrame, min_len: int = 300, hot: int = 64) -> DataFrame:
    """For every record: its characters, how many of them stand in another record, in how many stretches, and the share.

    Records without shared text have 0; NULL and empty texts have 0 characters and the share 0.
    """
    spans = shared_spans(docs, min_len, hot).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    base = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    zero = F.lit(0).cast("long")
    return base.join(spans, "doc_id", "left").select(
        "doc_id",
        "chars",
        F.coalesce("shared_chars", zero).alias("shared_chars"),
        F.coalesce("spans", zero).alias("spans"),
        F.when(F.col("chars") > 0, F.round(F.coalesce("shared_chars", zero) / F.col("chars"), 4)).otherwise(F.lit(0.0)).alias("share"),
    )
