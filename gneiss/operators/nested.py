"""Deeply nested JSON documents as flat tables that keep parent and child linked.

All documents of a batch are one array of bytes. Quotes, brackets and delimiters are found with whole-array comparisons; a prefix sum of quotes tells what lies
inside strings, a prefix sum of brackets gives the nesting depth, and sorting by depth gives every token its enclosing bracket. Whether a document is JSON is told from the same index, by what may
stand beside what, so there is no recursion and no limit of depth or of the size of numbers. Values, keys, paths and links are then taken for whole batches at once, paths level by level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "asset_seq long, path string, object_path string, parent_path string, section string, key string, position int, kind string, depth int, value string, `order` int"
_SCHEMA = pa.schema([("asset_seq", pa.int64()), ("path", pa.string()), ("object_path", pa.string()), ("parent_path", pa.string()), ("section", pa.string()), ("key", pa.string()), ("position", pa.int32()), ("kind", pa.string()), ("depth", pa.int32()), ("value", pa.string()), ("order", pa.int32())])
_KINDS = np.array(["object", "array", "string", "number", "boolean", "null"], dtype=object)
#: What a byte outside strings is: 1 to 6 the marks { [ } ] , : then 7 for a string, 8 for any other scalar; 0 for white space.
_MARK = np.full(256, 8, dtype=np.uint8)
for _i, _c in enumerate("{[}],:", 1):
    _MARK[ord(_c)] = _i
_MARK[[ord(c) for c in " \t\n\r"]] = 0
_OBJECT, _ARRAY, _END_OBJECT, _END_ARRAY, _COMMA, _COLON, _STRING, _SCALAR = range(1, 9)
_LITERAL = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_ESCAPE = re.compile(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})(.?)')
#: Bytes of documents that are taken at once, and levels whose paths are built for all nodes; deeper paths are built only for the rows that are asked for.
_BATCH, _LEVELS = 1 << 21, 64


class Tokens:
    """The tokens of a batch of documents: their place, end, mark, document, depth, and the token of the bracket around them (-1 for none)."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.base = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
        self.buf = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
        self.stop = np.array([b + len(r) for b, r in zip(self.base, raw)])
        buf, n = self.buf, len(self.buf)
        doc = np.repeat(np.arange(len(raw)), np.diff(np.r_[self.base, n]))
        quote = buf == ord('"')
        slash = buf == ord("\\")
        if slash.any():
            # a quote is escaped where an odd number of backslashes stands before it
            at = np.arange(n)
            run = np.r_[0, (at - np.maximum.accumulate(np.where(slash, -1, at)))[:-1]]
            quote &= run % 2 == 0
        seen = np.cumsum(quote)
        seen -= np.r_[0, seen][self.base][doc]  # each document begins outside of strings
        inside = ((seen - quote) & 1).astype(bool)
        self.open_string = (seen[np.maximum(self.stop - 1, 0)] & 1 == 1) & (self.stop > self.base)
        mark = np.where(inside | quote, 0, _MARK[buf])
        mark[quote & ~inside] = _STRING
        other = mark == _SCALAR
        mark[other & np.r_[False, other[:-1]]] = 0  # a scalar is one token
        self.at = np.flatnonzero(mark)
        self.mark, self.doc = mark[self.at], doc[self.at]
        ends = np.flatnonzero(other & ~np.r_[other[1:], False]) + 1
        close = np.flatnonzero(quote & inside) + 1
        self.end = self.at + 1
        scalar, string = self.mark == _SCALAR, self.mark == _STRING
        self.end[scalar] = ends
        k = np.searchsorted(close, self.at[string], side="right")
        self.end[string] = np.r_[close, n][k]
        control = np.flatnonzero(inside & (buf < 32))
        self.bad = self.open_string.copy()
        self.bad[np.unique(doc[control])] = True
        self._depths()

    def _depths(self) -> None:
        opening, closing = self.mark <= _ARRAY, (self.mark == _END_OBJECT) | (self.mark == _END_ARRAY)
        step = opening.astype(np.int64) - closing
        total = np.cumsum(step)
        first = np.searchsorted(self.doc, np.arange(len(self.base)))
        total -= np.r_[0, total][first][self.doc]
        self.depth = total - opening  # of an opening bracket that around it, of a closing one that inside less one
        self.level = np.where(closing, total + 1, total)  # brackets belong to the level they enclose
        low = np.zeros(len(self.base), dtype=np.int64)
        np.minimum.at(low, self.doc, total)
        last = np.r_[first[1:], len(total)] - 1
        self.bad |= (last < first) | (low < 0) | (np.r_[total, 0][last] != 0)
        order = np.lexsort((np.arange(len(total)), self.level, self.doc))
        lead = np.where(opening[order], np.arange(len(total)), -1)
        begins = np.r_[True, (self.doc[order][1:] != self.doc[order][:-1]) | (self.level[order][1:] != self.level[order][:-1])] if len(total) else np.empty(0, bool)
        lead = np.maximum.accumulate(np.where(begins & (lead < 0), np.arange(len(total)), lead)) if len(total) else lead
        own = np.empty(len(total), dtype=np.int64)
        own[order] = order[lead] if len(total) else lead
        own[~opening[own]] = -1
        self.bracket = np.where(opening, -1, own)  # for a closing bracket its opening one
        # the bracket around an opening one is the last opened before it in the level around: opening brackets are sorted by document and level, and searched
        self.around = np.where(opening | closing, -1, own)
        opens = np.flatnonzero(opening)
        if len(opens):
            span, width = int(self.level.max()) + 2, len(total) + 1
            packed = np.sort((self.doc[opens] * span + np.maximum(self.level[opens], 0)) * width + opens)
            group = self.doc[opens] * span + np.maximum(self.depth[opens], 0)
            found = packed[np.maximum(np.searchsorted(packed, group * width + opens) - 1, 0)]
            self.around[opens] = np.where((found // width == group) & (self.depth[opens] > 0) & (found % width < opens), found % width, -1)

    def valid(self) -> np.ndarray:
        """For each document whether it is JSON."""
        m, doc = self.mark, self.doc
        bad = self.bad.copy()
        n = len(m)
        if not n:
            return ~bad
        fault = np.zeros(n, dtype=bool)
        first = np.r_[True, doc[1:] != doc[:-1]]
        before = np.where(first, 0, np.r_[0, m[:-1]])
        closing = (m == _END_OBJECT) | (m == _END_ARRAY)
        container = np.where(closing, self.bracket, self.around)
        inside = np.where(container >= 0, m[np.maximum(container, 0)], 0)
        in_object = inside == _OBJECT
        fault |= (m == _END_OBJECT) & (inside != _OBJECT) | (m == _END_ARRAY) & (inside != _ARRAY)
        ended = (before == _STRING) | (before == _SCALAR) | (before == _END_OBJECT) | (before == _END_ARRAY)
        value = (m == _STRING) | (m == _SCALAR) | (m <= _ARRAY)
        key = (m == _STRING) & in_object & ((before == _OBJECT) | (before == _COMMA))
        key_before = np.r_[False, key[:-1]] & ~first
        fault |= value & ended  # two values side by side
        fault |= value & (before == 0) & ~first
        fault |= value & in_object & ~key & (before != _COLON)
        fault |= key_before & (m != _COLON)
        fault |= (m == _COLON) & ~key_before
        fault |= (m == _COMMA) & (~ended | key_before | (inside == 0))
        fault |= closing & (key_before | (before == _COMMA) | (before == _COLON))
        fault |= first & ~value
        bad[doc[fault]] = True
        scalar = np.flatnonzero(m == _SCALAR)
        if len(scalar):
            ok = pc.match_substring_regex(self.texts(scalar), _LITERAL).to_numpy(zero_copy_only=False)
            bad[doc[scalar[~ok]]] = True
        for d in np.unique(doc[(m == _STRING)]).tolist() if (self.buf == ord("\\")).any() else ():
            if not bad[d]:
                text = self.buf[self.base[d] : self.stop[d]].tobytes()
                if b"\\" in text and _ESCAPE.search(re.sub(rb"\\\\", b"", text).decode("utf-8", "surrogatepass")):
                    bad[d] = True
        # a backslash outside of strings is a scalar, which the literals refuse
        return ~bad

    def texts(self, tokens: np.ndarray, trim: int = 0) -> pa.Array:
        """The texts of tokens, without ``trim`` bytes at both ends."""
        lo, hi = self.at[tokens] + trim, self.end[tokens] - trim
        n = hi - lo
        offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
        where = np.repeat(lo - offsets[:-1], n) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(tokens), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.buf[where].tobytes()))

    def strings(self, tokens: np.ndarray) -> pa.Array:
        """What string tokens say."""
        out = self.texts(tokens, 1)
        escaped = pc.match_substring(out, "\\").to_numpy(zero_copy_only=False) if len(out) else np.empty(0, bool)
        if not escaped.any():
            return out
        said = out.to_pylist()
        for i in np.flatnonzero(escaped).tolist():
            said[i] = json.loads(f'"{said[i]}"').encode("utf-8", "replace").decode()
        return pa.array(said, pa.string())


def loads(text: str, number=float):
    """The value of a document of any depth; numbers are made by ``number``. A document that is not JSON raises ValueError."""
    t = Tokens([text])
    if not t.valid()[0]:
        raise ValueError("no JSON")
    words = {"true": True, "false": False, "null": None}
    texts = iter(t.texts(np.flatnonzero(t.mark == _SCALAR)).to_pylist())
    strings = iter(t.strings(np.flatnonzero(t.mark == _STRING)).to_pylist())
    stack: list = [[]]
    keys: list = [None]
    for m in t.mark.tolist():
        if m in (_END_OBJECT, _END_ARRAY):
            stack.pop()
            keys.pop()
            continue
        if m in (_COMMA, _COLON):
            continue
        if m == _STRING:
            value = next(strings)
            if isinstance(stack[-1], dict) and keys[-1] is None:
                keys[-1] = value
                continue
        elif m == _SCALAR:
            value = next(texts)
            value = words[value] if value in words else number(value)
        else:
            value = {} if m == _OBJECT else []
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = value
            keys[-1] = None
        else:
            stack[-1].append(value)
        if m in (_OBJECT, _ARRAY):
            stack.append(value)
            keys.append(None)
    return stack[0][0]


def flatten_batch(ids: list[int], texts: list[str], objects_only: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of ``NODES`` of the values of those documents that are JSON; ``objects_only`` leaves all but elements of arrays that are objects."""
    t = Tokens(texts)
    good = t.valid()
    m = t.mark
    before = np.r_[0, m[:-1]]
    inside = np.where(t.around >= 0, m[np.maximum(t.around, 0)], 0)
    value = (m == _STRING) | (m == _SCALAR) | (m <= _ARRAY)
    value &= ~((m == _STRING) & (inside == _OBJECT) & (before != _COLON))  # keys
    node = np.flatnonzero(value & good[t.doc])
    if not len(node):
        return
    row = np.full(len(m), -1, dtype=np.int64)
    row[node] = np.arange(len(node))
    parent = np.where(t.around[node] >= 0, row[np.maximum(t.around[node], 0)], -1)
    depth = t.level[node] - (m[node] <= _ARRAY)
    doc, mark = t.doc[node], m[node]
    item = inside[node] == _ARRAY
    position = np.zeros(len(node), dtype=np.int64)
    if item.any():
        # rank of an element among those of its array
        rows = np.flatnonzero(item)
        order = rows[np.lexsort((rows, parent[rows]))]
        head = np.flatnonzero(np.r_[True, parent[order][1:] != parent[order][:-1]])
        position[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
    member = inside[node] == _OBJECT
    keys = t.strings(node[member] - 2)
    place = np.full(len(node), -1, dtype=np.int64)
    place[member] = np.arange(member.sum())
    key = keys.take(pa.array(np.where(member, place, 0), mask=~member)) if len(keys) else pa.nulls(len(node), pa.string())
    index = pc.binary_join_element_wise("[", pc.cast(pa.array(position), pa.string()), "]", "")
    step = pc.coalesce(key, pc.if_else(pa.array(item), index, ""))
    element = item & (mark == _OBJECT)
    # the nearest enclosing element and the member of the top level, level by level
    near, top = np.full(len(node), -1, dtype=np.int64), np.full(len(node), -1, dtype=np.int64)
    by = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[by], np.arange(int(depth.max()) + 2))
    paths: list[pa.Array] = []
    where = np.full(len(node), -1, dtype=np.int64)
    made = 0
    for d in range(len(cut) - 1):
        at = by[cut[d] : cut[d + 1]]
        if d:
            up = parent[at]
            near[at] = np.where(element[up], up, near[up])
            top[at] = np.where(top[up] < 0, at, top[up])
        if d <= _LEVELS:
            own = step.take(pa.array(at))
            if d == 1:
                path = own
            elif d:
                path = pc.binary_join_element_wise(paths[d - 1].take(pa.array(where[parent[at]])), own, " > ")
            else:
                path = pa.array([""] * len(at), pa.string())
            paths.append(path)
            where[at] = np.arange(len(at))
    level_start = np.cumsum([0] + [len(p) for p in paths])
    whole = pa.chunked_array(paths).combine_chunks()
    shallow = depth <= _LEVELS
    flat = np.where(shallow, level_start[np.minimum(depth, _LEVELS)] + where, 0)
    steps = step.to_pylist() if not shallow.all() else []

    def path_of(rows: np.ndarray) -> pa.Array:
        out = whole.take(pa.array(np.where(rows < 0, 0, flat[rows]), mask=(rows < 0)))
        deep = np.flatnonzero((rows >= 0) & ~shallow[rows])
        if len(deep):
            said = out.to_pylist()
            for i in deep.tolist():
                r, parts = int(rows[i]), []
                while parent[r] >= 0:
                    parts.append(steps[r])
                    r = int(parent[r])
                said[i] = " > ".join(reversed(parts))
            out = pa.array(said, pa.string())
        return out

    kept = np.flatnonzero(element) if objects_only else np.arange(len(node))
    kind = np.select([mark == _OBJECT, mark == _ARRAY, mark == _STRING], [0, 1, 2], 3)
    scalar = t.buf[t.at[node]]
    kind[(kind == 3) & ((scalar == ord("t")) | (scalar == ord("f")))] = 4
    kind[(kind == 3) & (scalar == ord("n"))] = 5
    ids_of, order = np.array(ids)[doc], t.at[node] - t.base[doc]
    for a in range(0, len(kept), 16384):
        r = kept[a : a + 16384]
        k = kind[r]
        said = np.full(len(r), -1, dtype=np.int64)
        text, other = np.flatnonzero(k == 2), np.flatnonzero((k == 3) | (k == 4))
        said[text], said[other] = np.arange(len(text)), len(text) + np.arange(len(other))
        values = pa.chunked_array([t.strings(node[r[text]]), t.texts(node[r[other]])]).combine_chunks()
        value_of = values.take(pa.array(np.maximum(said, 0), mask=said < 0)) if len(values) else pa.nulls(len(r), pa.string())
        path = path_of(r)
        columns = [
            pa.array(ids_of[r]), path, pc.if_else(pa.array(element[r] | (depth[r] == 0)), path, pa.scalar(None, pa.string())), pc.coalesce(path_of(near[r]), ""), step.take(pa.array(np.maximum(top[r], 0), mask=top[r] < 0)),
            key.take(pa.array(r)), pa.array(position[r].astype(np.int32), mask=~item[r]), pa.array(_KINDS[k], pa.string()), pa.array(depth[r].astype(np.int32)), value_of, pa.array(order[r].astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _flattener(objects_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                if size > _BATCH:
                    yield from flatten_batch(ids, texts, objects_only)
                    ids, texts, size = [], [], 0
            if texts:
                yield from flatten_batch(ids, texts, objects_only)

    return run


def json_nodes(assets: DataFrame, objects_only: bool = False) -> DataFrame:
    """One row for every value of every valid document in ``dynamic_payload``, with the columns of ``NODES``.

    ``path`` joins keys and ``[i]`` by `` > `` ('' for the document itself); ``object_path`` is set for objects that are array elements and names themselves; ``parent_path`` is
    the nearest enclosing such object ('' where there is none); ``section`` is the first step of the path. ``value`` is the text of a string, the literal of another scalar, NULL for null,
    objects and arrays; ``order`` is where the value begins. NULL, empty and invalid documents have no row; a document and id that come again count once. With
    ``objects_only`` there are rows only for objects that are array elements, and those of a repeated row come again.
    """
    d = assets.select(F.col("asset_seq").cast("long"), "dynamic_payload").filter("dynamic_payload <> ''")
    return (d if objects_only else d.dropDuplicates()).mapInArrow(_flattener(objects_only), NODES)


def flat_assets(assets: DataFrame) -> DataFrame:
    """One row an asset whose document is valid: its sections and objects counted."""
    objects = F.count(F.when((F.col("depth") > 0) & F.col("object_path").isNotNull(), 1)).alias("objects")
    return json_nodes(assets).groupBy("asset_seq").agg(F.count(F.when(F.col("depth") == 1, 1)).alias("sections"), objects, F.max("depth").alias("deepest"))


def flat_sections(assets: DataFrame) -> DataFrame:
    """``(asset_seq, section, kind, entries)`` of every member of a document's top level, ``entries`` being its direct members."""
    n = json_nodes(assets).filter("depth in (1, 2)")
    return n.groupBy("asset_seq", "section").agg(F.max(F.when(F.col("depth") == 1, F.col("kind"))).alias("kind"), F.count(F.when(F.col("depth") == 2, 1)).alias("entries"))


def flat_objects(assets: DataFrame) -> DataFrame:
    """``(asset_seq, object_path, parent_path)`` of every object that is an element of an array, at any depth."""
    return json_nodes(assets, objects_only=True).filter("depth > 0").select("asset_seq", "object_path", "parent_path").distinct()


def flat_fields(assets: DataFrame) -> DataFrame:
    """``(asset_seq, path, parent_path, section, key, position, kind, value)`` of every scalar inside a document; a member that a document names twice comes twice."""
    return json_nodes(assets).filter("depth > 0 and kind not in ('object', 'array')").select("asset_seq", "path", "parent_path", "section", "key", "position", "kind", "value")
