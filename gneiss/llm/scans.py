"""Noise in text from scanned pages: finding it, and repairing the text into continuous paragraphs.

The lexicon is made of all words of all texts with their counts. Rare words are compared with frequent ones through a symmetric-delete index: both sides are joined on what is left when one
character or two neighbouring ones are deleted. Candidates are weighed by an edit distance that knows only the confusions of scanners, and where several remain the
word before decides. Heads and feet are lines that many pages of a source share, apart from page numbers and misread characters.

Lexicon, heads and decisions stay tables: texts are joined with the heads of their source, and words and cuts that a text holds with the lexicon. Only the commonest words, a fixed number
of them, go to all tasks, so that these need not be joined; results do not depend on which they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.codes import code_points, mix, powers, prefix_hash
from gneiss.tables import cut_lineage

#: What scanners read for what, in lower case (printed, read), and their weight; anything else is no confusion.
CONFUSIONS = {
    ("e", "c"): 0.5, ("c", "e"): 0.7, ("n", "u"): 0.5, ("u", "n"): 0.8, ("a", "o"): 0.5, ("o", "a"): 0.9, ("t", "f"): 0.5, ("v", "y"): 0.6,
    ("i", "í"): 0.4, ("o", "0"): 0.4, ("l", "1"): 0.4, ("i", "1"): 0.5, ("s", "5"): 0.4, ("g", "9"): 0.4, ("b", "6"): 0.4, ("b", "8"): 0.5, ("l", "|"): 0.4, ("i", "|"): 0.5,
    ("d", "cl"): 0.5, ("u", "ii"): 0.5, ("h", "li"): 0.6, ("m", "rn"): 0.5, ("w", "vv"): 0.5,
    ("in", "m"): 0.6, ("ri", "n"): 0.6, ("rn", "m"): 0.6, ("ti", "h"): 0.6,
}
#: Digits and the letters read for them.
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5", "B": "8"}
#: Marks that cut a word at a line end; all but the first are never part of a word.
MARKS = "-‐\xad¬"

_L = "A-Za-zÀ-ɏ0-9"
_WORD = re.compile(rf"\|*[{_L}][{_L}|]*")
_FIRST = re.compile(rf"\s*({_WORD.pattern})")
_CODE = re.compile(r"\b[A-Z]{2,4}-\d+")
_COMPOUND = re.compile(f"(?<![{_L}-])[{_L}]++(?:-[{_L}]++)++(?![{_L}-])")
_BREAK = re.compile(f"([{MARKS}])[ \t]*\r?\n[ \t]*")
_RUN = re.compile(f"[{_L}|]*")
_DIGIT = r"(?:[\dlIOSBo|](?:,(?=\d{3}))?)"
_NUM = rf"(?=[^\n]*\d){_DIGIT}{{1,6}}"
_SPACED = r"(?=[^\n]*\d)[\dlIOSB](?: [\dlIOSB]){1,5}"
_BARE = re.compile(rf"^(?:{_NUM}|{_SPACED}|[ivxlc]+)$")
_PAGENO = re.compile(
    rf"^(?:\[ ?{_NUM} ?\]|\( ?{_NUM} ?\)|(?:page|p\.|seite|s\.|pg\.|p|blatt) ?{_NUM}\.?|{_NUM} ?\||[-–—] ?{_NUM} ?[-–—]|{_NUM} (?:of|von) {_NUM}|{_NUM} ?/ ?{_NUM}|\. ?{_NUM}|[A-Z]-{_NUM})$", re.I
)
_MISREAD_NUMBER = re.compile(r"^(?=.*\d)(?=.*[OolISB|])[\dOolISB|]+$")
_DIGIT_INSIDE = re.compile(r"^(?=(?:.*[a-zà-ɏ]){3})[a-zà-ɏ|]*[013-9|][a-zà-ɏ|]*$")
_ROMAN = re.compile(r"^[ivxlcdm]+$")
_READ_FOR_DIGITS = "lLiIıİoOsSſbB"
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_NO_LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())
_SHEET_END = re.compile(r"\s*[-–—]+\s*(?:sheet|page|p\.|seite|blatt)\s*\S{1,6}$|\s+[\dlIOSB]{1,6}$", re.I)
_SHEET_START = re.compile(r"^[\dlIOSB]{1,6}\s+", re.I)

#: Least count of a frequent word.
LEAST = 8
#: How many of the commonest words every task holds, which spares them a join.
HELD = 1 << 18
#: Parts into which the texts of one source are cut where they are joined with its heads.
_SALTS = 16


def head_key(line: str) -> str:
    """A line apart from its page number, case, and everything but letters."""
    s = line.strip()
    # where a line does not begin or end with a digit, or what is read for one, or hold a dash, there is no page number
    if s and (s[0].isdecimal() or s[0] in _READ_FOR_DIGITS):
        s = _SHEET_START.sub("", s, count=1)
    if s and (s[-1].isdecimal() or s[-1] in _READ_FOR_DIGITS or "-" in s or "–" in s or "—" in s):
        s = s[:-64] + _SHEET_END.sub("", s[-64:])
    return s.encode().translate(_LOWER, _NO_LETTERS).decode() if s.isascii() else re.sub(r"[\W\d_]+", "", s).lower()


def head_line(line: str) -> str | None:
    """The key of a stripped line that may be a running head or foot; None for rows of tables, for lines that end in a stop, comma or colon, as sentences do, and for lines of
    fewer than ten letters, of which a Chinese one counts as three."""
    if line[0] == "|" or line[-1] in ".。,;:" or len(key := head_key(line)) < 4:
        return None
    return key if len(key) >= 10 or not key.isascii() and sum(3 if c > "\u2e80" else 1 for c in key) >= 10 else None


def parts(word: str, n: int) -> list[str]:
    """``word`` cut into ``n`` parts."""
    return [word[len(word) * i // n : len(word) * (i + 1) // n] for i in range(n)]


def edits(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements turn one into the other. Only places at most so far apart are compared, and only while there is hope."""
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    width, far = 2 * most + 1, most + 1
    padded = "\0" * most + b + "\0" * width
    # for each difference of places, from -most on, the edits so far
    row = [far] * most + list(range(most + 1)) + [far]
    for i, x in enumerate(a):
        last, new = far, []
        for d, y in enumerate(padded[i : i + width]):
            last = row[d] if x == y else 1 + min(row[d], row[d + 1], last)
            new.append(last)
        if min(new) > most:
            return False
        row = [*new, far]
    return row[len(b) - len(a) + most] <= most


class Heads:
    """The head keys of one source, and whether a line is one of them, misread ones included unless ``exact``."""

    def __init__(self, keys, exact: bool = False):
        self.keys = frozenset(keys)
        # so many edits leave one of most + 1 parts as it is
        near = [] if exact else [(k, most, parts(k, most + 1)) for k in self.keys for most in (max(1, len(k) // 8),)]
        self.by_length: dict[int, list[tuple[str, int, list[str]]]] = {}
        for head in near:
            for n in range(len(head[0]) - head[1], len(head[0]) + head[1] + 1):
                self.by_length.setdefault(n, []).append(head)

    def has(self, key: str) -> bool:
        if key in self.keys:
            return True
        for head, most, held in self.by_length.get(len(key), ()):
            for p in held:
                if p in key:
                    if edits(head, key, most):
                        return True
                    break
        return False


def breaks(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start and end of what a mark at a line end divides, and the parts: left, mark, right."""
    at = 0
    for m in _BREAK.finditer(text):
        k, n = m.start(), 64
        left = _RUN.match(text[max(at, k - n) : k][::-1])[0]
        while len(left) == n and k - n > at:
            n *= 4
            left = _RUN.match(text[max(at, k - n) : k][::-1])[0]
        right = _RUN.match(text, m.end())[0]
        at = m.end() + len(right)
        yield k - len(left), at, left[::-1], m[1], right


def without_cuts(text: str) -> str:
    """The text with a space in place of every word that a line end divides."""
    out, at = [], 0
    for a, b, *_ in breaks(text):
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]]) if out else text


def words_of(text: str) -> list[str]:
    """Lower-case words of a text without codes and without words cut at a line end."""
    return _WORD.findall(without_cuts(_CODE.sub(" ", text)).lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def flush() -> pa.RecordBatch:
        kept = [(w, k) for w, k in n.items() if not w.isdigit()]
        n.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([k for _, k in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                n.update(words_of(t))
                if "-" in t:
                    n.update(c.lower() for c in _COMPOUND.findall(t) if not _CODE.match(c))
        if len(n) > 1 << 19:
            yield flush()
    if n:
        yield flush()


def word_counts(records: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts: lower-case words in Latin letters and digits, and compounds with hyphens."""
    return records.select("text").filter("text is not null").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hashes of itself and of it without any one character or any two neighbouring ones: rows of ``words`` and hashes, once each.

    A hash is a sum of codes times powers by place, so that of a word with a gap is made of two prefix sums and takes the same time for words of any length.
    """
    lengths = np.array([len(w) for w in words])
    codes = code_points("".join(words))
    p = prefix_hash(codes)
    first = np.cumsum(lengths) - lengths
    _, inverse = powers(len(codes) + 3)
    row, out = [np.arange(len(words))], [(p[first + lengths] - p[first]) * inverse[first]]
    for gap in (1, 2):
        n = np.maximum(lengths - gap + 1, 0)
        r = np.repeat(np.arange(len(words)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[r]
        row.append(r)
        out.append((p[at] - p[first[r]]) * inverse[first[r]] + (p[first[r] + lengths[r]] - p[at + gap]) * inverse[first[r]] * inverse[gap])
    row, h = np.concatenate(row), mix(np.concatenate(out)).view(np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    kept = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
    return row[kept], h[kept]


def confusion_weight(printed: str, read: str) -> float | None:
    """The least total weight of confusions that turn ``printed`` into ``read``; None if other changes are needed or they exceed 1.4."""
    while printed and read and printed[0] == read[0]:
        printed, read = printed[1:], read[1:]
    while printed and read and printed[-1] == read[-1]:
        printed, read = printed[:-1], read[:-1]

    # for each place in ``printed`` the places in ``read`` reached, and for how much
    reached: list[dict[int, float]] = [{0: 0.0}, *({} for _ in range(len(printed) + 1))]
    for i in range(len(printed)):
        if not reached[i] and not reached[i + 1]:
            return None
        for j, spent in reached[i].items():
            options = [(1, 1, 0.0)] if j < len(read) and printed[i] == read[j] else []
            options += [(a, b, w) for a, b in ((1, 1), (1, 2), (2, 1)) if (w := CONFUSIONS.get((printed[i : i + a], read[j : j + b])))]
            for a, b, w in options:
                total = round(spent + w, 6)
                if total <= 1.4 and total < reached[i + a].get(j + b, 2.0):
                    reached[i + a][j + b] = total
    return reached[len(printed)].get(len(read))


def _weight(read: str, printed: str) -> float | None:
    w = confusion_weight(printed, read)
    if w is not None:
        return w
    # once more with one shared character on either side left in place
    k = 0
    while k < min(len(read), len(printed)) and read[k] == printed[k]:
        k += 1
    a, b = printed[max(0, k - 1) :], read[max(0, k - 1) :]
    k = 0
    while k < min(len(a), len(b)) - 1 and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - max(0, k - 1)], b[: len(b) - max(0, k - 1)]
    return next((w for (p, r), w in CONFUSIONS.items() if len(p) + len(r) > 2 and p in a and a.replace(p, r, 1) == b), None)


def _deleter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        if words:
            row, key = deletion_hashes(words)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(at), batch.column(1).take(at)], ["key", "word", "n"])


def _weigher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read, printed, n = (batch.column(i).to_pylist() for i in range(3))
        w = [_weight(a, b) for a, b in zip(read, printed)]
        keep = [i for i, x in enumerate(w) if x is not None]
        yield pa.RecordBatch.from_arrays([pa.array([read[i] for i in keep], pa.string()), pa.array([printed[i] for i in keep], pa.string()), pa.array([n[i] for i in keep], pa.int64()), pa.array([w[i] for i in keep], pa.float64())], ["read", "printed", "n", "weight"])


def misread_words(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """``(read, printed, n, weight)``: words that a frequent word, eight times as common or more (fifty for three letters), becomes by confusions. ``n`` is that of the frequent word.

    A word is compared only with words that are left the same by a deletion, by hashes; what hashes bring together by chance has no weight. Confusions are those of Latin letters and digits.
    """
    words = counts.filter((F.length("word") >= 3) & ~F.col("word").contains("-") & ~F.col("word").rlike(_ROMAN.pattern))
    index = "key long, word string, n long"
    rare = words.mapInArrow(_deleter, index).select("key", F.col("word").alias("read"), F.col("n").alias("few"))
    often = words.filter(F.col("n") >= least).filter(~F.col("word").rlike("[0-9|]")).mapInArrow(_deleter, index).select("key", F.col("word").alias("printed"), "n")
    pairs = rare.join(often, "key").filter("n >= 8 * few and read <> printed and (length(printed) > 3 or n >= 50 * few)").select("read", "printed", "n").distinct()
    return pairs.mapInArrow(_weigher, "read string, printed string, n long, weight double")


def _visible(text: str) -> list[str]:
    return [s for line in text.split("\n") if (s := line.strip())]


def page_number_lines(lines: list[str], anywhere: bool) -> list[tuple[int, bool]]:
    """Places of lines that give only a page number; the flag tells that the line counts only beside a running head.

    Away from notes only the first and last lines of a page are looked at, and a bare number beside another bare number is part of a list.
    """
    out = []
    n = len(lines)
    for i in range(n) if anywhere else sorted({i for i in (0, 1, n - 2, n - 1) if 0 <= i < n}):
        s = " ".join(lines[i].split())
        if len(s) > 40:
            continue
        if _PAGENO.match(s):
            out.append((i, False))
        elif _BARE.match(s):
            if anywhere:
                out.append((i, False))
                continue
            edge = min(i, n - 1 - i)
            inner = lines[i + 1 if i < n / 2 else i - 1] if n > 1 else ""
            if not _BARE.match(" ".join(inner.split())):
                out.append((i, edge > 0))
    return out


def head_places(lines: list[str], skip: set[int], heads: Heads) -> dict[int, str]:
    """Places and keys of lines that are running heads or feet, wherever in the text they stand."""
    out = {}
    for i, line in enumerate(lines):
        if i not in skip and (key := head_line(line)) and heads.has(key):
            out[i] = key
    return out


def cleaned(text: str, note: bool, heads: Heads | None) -> tuple[str, list[str], bool]:
    """A text without its running heads and page numbers, the keys of the heads, and whether there was a page number."""
    raw = text.split("\n")
    full = [i for i, line in enumerate(raw) if line.strip()]
    lines = [raw[i].strip() for i in full]
    numbers = page_number_lines(lines, note)
    found = head_places(lines, {i for i, _ in numbers}, heads) if heads else {}
    headed = note and bool(found) or any(i < 3 or i >= len(lines) - 3 for i in found)
    pages = [i for i, beside in numbers if headed or not beside]
    drop = {full[i] for i in [*pages, *found]}
    return "\n".join(line for i, line in enumerate(raw) if i not in drop) if drop else text, list(found.values()), bool(pages)


def _known_compounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts ``(left, right, next)`` beside which a known part stands for the one read: columns left, right, next, printed, read."""
    for batch in batches:
        keep = [i for i, (p, r) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())) if confusion_weight(p, r) is not None]
        yield batch.take(pa.array(keep, pa.int64())).select([0, 1, 2])


def real_cuts(cuts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(left, right, next)`` of those hyphens at line ends that cut a word, rather than being that of a compound or code.

    ``cuts``: left, right and ``next``, the first word of the line after; each '' (or NULL, which reads as '') where there is none. ``lexicon``: word. A cut joins to a known word, or is no known compound, also not
    one with a misread character.
    """
    cols = ["left", "right", "next"]
    c = cuts.select(*[F.coalesce(k, F.lit("")).alias(k) for k in cols]).distinct().withColumns({k: F.lower(v) for k, v in zip("abc", cols)})
    role = lambda name, word, ok: F.when(ok, F.struct(F.lit(name).alias("role"), word.alias("word")))
    a, b, n = F.col("a"), F.col("b"), F.col("c")
    dash = F.lit("-")
    asked = F.array_compact(F.array(role("ab", F.concat(a, b), b != ""), role("ac", F.concat(a, n), n != ""), role("a-b", F.concat(a, dash, b), b != ""), role("a-c", F.concat(a, dash, n), n != "")))
    held = c.select("left", "right", "next", F.explode(asked).alias("q")).select("left", "right", "next", "q.role", "q.word").join(lexicon.select("word"), "word", "left_semi")
    found = held.groupBy(*cols).agg(F.collect_set("role").alias("roles"))  # at most four
    c = cut_lineage(c.join(found, cols, "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>"))))
    has = lambda name: F.array_contains("roles", name)
    part = (a == "") | (b == "")
    code = F.col("left").rlike("^[A-Z]{2,4}$") | a.rlike("^[0-9]+$") | b.rlike("^[0-9]+$")
    verdict = F.when(part, (a != "") & has("ac")).when(~has("a-b") & (has("ab") | has("ac")), True).when(code | has("a-b") | has("a-c"), False)
    c = c.withColumn("verdict", verdict)
    open_ = c.filter("verdict is null")
    compounds = lexicon.filter(F.col("word").contains("-")).select(F.substring_index("word", "-", 1).alias("head"), F.expr("substring(word, instr(word, '-') + 1)").alias("rest"))
    misread = open_.join(compounds, F.col("a") == F.col("head")).select(*cols, F.col("rest").alias("printed"), F.col("b").alias("read")).union(open_.join(compounds, F.col("b") == F.col("rest")).select(*cols, "head", "a"))
    named = misread.mapInArrow(_known_compounds, "left string, right string, next string").distinct()
    rest = open_.join(named, cols, "left_anti").select(*cols)
    return c.filter("verdict").select(*cols).union(rest)


class Sieve:
    """A set of words in four megabytes at most: all words of the set are in it, and a few others."""

    def __init__(self, words: Iterator[str]):
        self.bits = np.zeros(1 << 22, dtype=np.uint8)
        for w in words:
            h = zlib.crc32(w.encode()) & 0x1FFFFFF
            self.bits[h >> 3] |= 1 << (h & 7)

    def __contains__(self, word: str) -> bool:
        h = zlib.crc32(word.encode()) & 0x1FFFFFF
        return bool(self.bits[h >> 3] >> (h & 7) & 1)


_MARKS = "kind string, table_name string, record_id long, what string, before string, following string, n long"
_MARK_SCHEMA = pa.schema([("kind", pa.string()), ("table_name", pa.string()), ("record_id", pa.int64()), ("what", pa.string()), ("before", pa.string()), ("following", pa.string()), ("n", pa.int64())])


def cuts(text: str) -> Iterator[tuple[str, str, str, str, int, int]]:
    """Words that end a line with a mark: left, mark, right, the first word of the line after next, start and end."""
    for a, b, left, mark, right in breaks(text):
        nxt = text.find("\n", b)
        following = _FIRST.match(text, nxt + 1) if nxt >= 0 else None
        yield left, mark, right, following[1] if following else "", a, b


class HeadsOf:
    """Heads by source; those of the last few thousand sources are kept ready."""

    def __init__(self):
        self.held: dict = {}

    def get(self, of: tuple, column: pa.Array, row: int) -> Heads | None:
        if of not in self.held:
            if len(self.held) > 4096:
                self.held.clear()
            keys = column[row].as_py()
            self.held[of] = Heads(keys) if keys else None
        return self.held[of]


def _marker(held, asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, want, heads = held.value, asked.value, HeadsOf()
        pairs: Counter = Counter()
        for batch in batches:
            rows = []
            for at, (name, record, source, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                if not text:
                    continue
                body, found, numbered = cleaned(text, name == "weg_assets", heads.get((name, source), batch.column(4), at))
                rows += [("header", name, record, key, None, None, None) for key in dict.fromkeys(found)]
                if numbered:
                    rows.append(("pageno", name, record, None, None, None, None))
                broken = _BREAK.search(text)
                if broken:
                    for i, (left, mark, right, following, *_) in enumerate(cuts(body)):
                        if mark == "-":
                            rows.append(("cut", name, record, left, right, following, i))
                        elif left:
                            rows.append(("hyphen", name, record, None, None, None, None))
                            rows += [("word", name, record, joined, None, None, None)] if right and (joined := (left + right).lower()) not in k else []
                # words are looked at in heads too
                body = _CODE.sub(" ", without_cuts(text) if broken else text)
                low = _WORD.findall(body.lower())
                different = set(low)
                if want and any(w in want for w in different):
                    pairs.update((a, b) for a, b in zip(low, low[1:]) if b in want)
                odd = {w for w in different - k if not w.isdigit()}
                if odd:
                    raw = _WORD.findall(body)
                    if len(raw) != len(low):  # a letter whose lower case is two
                        raw, low = raw, [w.lower() for w in raw]
                        odd = {w for w in set(low) - k if not w.isdigit()}
                    rows += [("number" if _MISREAD_NUMBER.match(raw[i]) else "word", name, record, w, low[i - 1] if i else "", None, None) for i, w in enumerate(low) if w in odd]
                if len(rows) > 20000:
                    yield to_batch(rows)
                    rows = []
            if rows:
                yield to_batch(rows)
            if len(pairs) > 1 << 18:
                yield counted(pairs)
                pairs.clear()
        if pairs:
            yield counted(pairs)

    def counted(pairs: Counter) -> pa.RecordBatch:
        none, keys = [None] * len(pairs), list(pairs)
        columns = [["pair"] * len(pairs), none, none, [b for _, b in keys], [a for a, _ in keys], none, [pairs[x] for x in keys]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MARK_SCHEMA)], schema=_MARK_SCHEMA)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*dict.fromkeys(rows)), _MARK_SCHEMA)], schema=_MARK_SCHEMA)

    return run


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, record, source, page, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if text:
                note = name == "weg_assets"
                keys = [head_line(line) for line in _visible(text)]
                edge = set(keys if note else keys[:3] + keys[-3:])
                rows += [(name, source, record if note else page, k, k in edge) for k in set(keys) if k]
        if rows:
            name, source, spot, key, edge = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(source, pa.string()), pa.array(spot, pa.int64()), pa.array(key, pa.string()), pa.array(edge)], ["table_name", "source", "spot", "head", "edge"])


def head_keys(records: DataFrame) -> DataFrame:
    """``(table_name, source, head)``: lines that stand anywhere on at least two pages, and a twentieth of the pages, of a source, and on two of these
    among the first or last three lines, as a sentence may come again too; for notes anywhere on three and a five-hundredth of the notes.

    Lines are counted by hashes of 64 bits.
    """
    lines = records.select("table_name", "record_id", "source", "page", "text").mapInArrow(_line_keys, "table_name string, source string, spot long, head string, edge boolean")
    lines = lines.withColumn("s", F.xxhash64("table_name", "source")).withColumn("h", F.xxhash64("head"))
    note = F.col("table_name") == "weg_assets"
    spots = lines.groupBy("s", "h", "spot", note.alias("note")).agg(F.max("edge").alias("edge"), F.first("head").alias("head"), F.first("table_name").alias("table_name"), F.first("source").alias("source"))
    seen = spots.groupBy("s", "h").agg(F.count("*").alias("n"), F.count_if("edge").alias("edges"), *[F.first(c).alias(c) for c in ("head", "table_name", "source")]).filter("edges > 1")
    spot = F.when(note, F.col("record_id")).otherwise(F.col("page").cast("long")).alias("spot")
    seen_pages = records.filter(F.trim("text") != "").select(F.xxhash64("table_name", "source").alias("s"), spot, note.alias("note")).distinct()
    size = seen_pages.groupBy("s", "note").agg(F.count("*").alias("pages"))
    need = F.when(F.col("note"), F.greatest(F.lit(3), F.col("pages") / 500)).otherwise(F.greatest(F.lit(2), F.col("pages") / 20))
    return seen.join(size, "s").filter(F.col("n") >= need).select("table_name", "source", "head")


class Survey:
    """What all texts together tell: the lexicon, the misread words, the heads, and the marks found in each record.

    With ``pairs`` the same pass also counts what stands before the words that a misread word may have been.
    """

    def __init__(self, records: DataFrame, pairs: bool = False):
        spark = records.sparkSession
        self.counts = cut_lineage(word_counts(records))
        self.misread = cut_lineage(misread_words(self.counts))
        wrong = self.misread.select(F.col("read").alias("word")).distinct()
        often = self.counts.filter((F.col("n") >= LEAST) & ~F.col("word").rlike("^[0-9olisb|]*[0-9][0-9olisb|]*$")).join(wrong, "word", "left_anti")
        self.lexicon = cut_lineage(often.select("word", "n"))
        held = spark.sparkContext.broadcast(frozenset(r["word"] for r in self.lexicon.orderBy(F.desc("n"), "word").limit(HELD).select("word").toLocalIterator()))
        wanted = spark.createDataFrame([], "printed string")
        if pairs:
            # words among which the word before has to choose
            rivals = self.misread.groupBy("read").agg(F.collect_set("printed").alias("printed")).filter("size(printed) > 1").select(F.explode("printed").alias("printed")).distinct()
            wanted = cut_lineage(rivals)
        few = wanted.count() <= HELD
        asked = spark.sparkContext.broadcast((frozenset if few else Sieve)(r["printed"] for r in wanted.toLocalIterator()) if pairs else frozenset())
        named = head_keys(records).groupBy("table_name", "source").agg(F.collect_set("head").alias("heads"))
        # twenty heads for each line of a page at most; a source with many pages is joined in parts
        self.named = cut_lineage(named.select("table_name", F.coalesce("source", F.lit("")).alias("source"), "heads"))
        marks = with_heads(records, self.named).select("table_name", "record_id", "source", "text", "heads").mapInArrow(_marker(held, asked), _MARKS)
        self.marks = cut_lineage(marks)
        cut = self.marks.filter("kind = 'cut'").select("table_name", "record_id", F.col("what").alias("left"), F.col("before").alias("right"), F.col("following").alias("next"), "n").distinct()
        # words of a text that were cut: table_name, record_id, left, right and their number among its cuts
        self.cut = cut_lineage(cut.join(real_cuts(cut, self.lexicon), ["left", "right", "next"]).select("table_name", "record_id", "left", "right", "n"))

    def misread_places(self) -> DataFrame:
        """``(table_name, record_id, what, before)`` of misread words and numbers."""
        places = self.marks.filter("kind in ('word', 'number')").select("kind", "table_name", "record_id", "what", "before")
        joined = self.cut.filter("right <> ''").select(F.lit("word"), "table_name", "record_id", F.lower(F.concat("left", "right")), F.lit(None).cast("string"))
        places = places.union(joined)
        sure = places.filter((F.col("kind") == "number") | F.col("what").rlike(_DIGIT_INSIDE.pattern) & ~F.col("what").contains("|"))
        other = places.filter("kind = 'word'").join(self.misread.select(F.col("read").alias("what")).distinct(), "what", "left_semi")
        return sure.select("table_name", "record_id", "what", "before").union(other.select("table_name", "record_id", "what", "before"))


def with_heads(records: DataFrame, named: DataFrame) -> DataFrame:
    """``records`` with ``heads``, the head keys of their source. ``named``: table_name, source, heads. Where Spark does not send ``named`` to all tasks, a source is joined in parts."""
    salts = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    r = records.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(_SALTS)).cast("int"))
    return r.join(salts, ["table_name", "source", "salt"], "left").drop("salt")


def noise_kinds(records: DataFrame) -> DataFrame:
    """Distinct ``(table_name, record_id, noise_kind)`` of the noise in each text: hyphen, misread, header, pageno.

    ``records``: table_name, record_id, source, page, text; ``table_name`` ``weg_assets`` means notes, which may have heads and page numbers anywhere; other texts are
    pages, with page numbers at their head or foot and heads anywhere. NULL and empty texts have no row; repeated rows count once.
    """
    s = Survey(records)
    kind = F.when(F.col("kind") == "header", "header").otherwise(F.col("kind")).alias("noise_kind")
    found = s.marks.filter("kind in ('hyphen', 'pageno', 'header')").select("table_name", "record_id", kind)
    found = found.union(s.cut.select("table_name", "record_id", F.lit("hyphen")))
    return found.union(s.misread_places().select("table_name", "record_id", F.lit("misread"))).distinct()


def repairs(s: Survey) -> DataFrame:
    """``(table_name, record_id, what, before, printed)``: the word chosen for each misread word in its place.

    Of several candidates the one that follows the word before most often is taken, then the one of least weight, then the commonest. ``s`` has been made with ``pairs``.
    """
    places = s.misread_places().distinct()
    options = places.join(s.misread.withColumnRenamed("read", "what"), "what")
    pairs = s.marks.filter("kind = 'pair'").groupBy("before", F.col("what").alias("printed")).agg(F.sum("n").alias("pair"))
    ranked = options.join(pairs, ["before", "printed"], "left").withColumn("pair", F.coalesce("pair", F.lit(0)))
    w = Window.partitionBy("table_name", "record_id", "what", "before").orderBy(F.desc("pair"), "weight", F.desc("n"), "printed")
    return ranked.withColumn("r", F.row_number().over(w)).filter("r = 1").select("table_name", "record_id", "what", "before", "printed")


def _as_written(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def repaired(text: str, note: bool, heads: Heads | None, fixes: dict[tuple[str, str], str], joined: set[int], noisy: bool) -> str:
    """A scanned text as paragraphs of one line each, without cuts, misread words, heads and page numbers. ``joined``: numbers of the hyphens at line ends that cut a word."""
    if not noisy:
        return text
    text = cleaned(text, note, heads)[0]
    out, at = [], 0
    for i, (left, mark, right, _, a, b) in enumerate(cuts(text)):
        real = i in joined if mark == "-" else bool(left)
        out += [text[at:a], left + right if real else left + mark + right]
        at = b
    text = "".join([*out, text[at:]]).replace("\r\n", "\n")
    any_before = {w: p for (w, _), p in fixes.items()}
    wrong = {w for w in set(_WORD.findall(text)) if any_before and w.lower() in any_before or not w.isalpha() and _MISREAD_NUMBER.match(w)}
    out, at, before = [], 0, ""
    for m in _WORD.finditer(text) if wrong else ():
        w = m[0]
        if w in wrong:
            if _MISREAD_NUMBER.match(w):
                new = "".join(DIGITS.get(c, c) for c in w)
            else:
                low = w.lower()
                new = _as_written(fixes.get((low, before.lower())) or any_before[low], w)
            out += [text[at : m.start()], new]
            at = m.end()
        before = w
    text = "".join([*out, text[at:]])
    blocks = re.split(r"\n(?:[ \t]*\n)+", text)
    return "\n\n".join(" ".join(line.strip(" \t") for line in b.split("\n")).strip() if "|" not in b else b.strip("\n") for b in blocks if b.strip())


def repaired_texts(records: DataFrame) -> DataFrame:
    """``(table_name, record_id, text, changed)`` of every record, the noise of scanned pages removed; clean texts stay as they are.

    A text counts as scanned where any noise was found in it. NULL and empty texts stay; repeated rows come out repeated.
    """
    s = Survey(records, pairs=True)
    key = ["table_name", "record_id"]
    fixes = repairs(s).groupBy(*key).agg(F.collect_list(F.struct("what", "before", "printed")).alias("fixes"))
    joins = s.cut.groupBy(*key).agg(F.collect_set(F.col("n").cast("int")).alias("joins"))
    noisy = s.marks.filter("kind in ('hyphen', 'pageno', 'number', 'header')").select(*key).distinct().withColumn("marked", F.lit(True))
    heads = s.marks.filter("kind = 'header'").groupBy(*key).agg(F.collect_set("what").alias("heads"))
    about = fixes.join(joins, key, "full").join(noisy, key, "full").join(heads, key, "full")
    # written, so that Spark knows its size: a small table goes to the texts, and a large one is joined with them by shuffle
    about = cut_lineage(about.select(*key, F.to_json("fixes").alias("fixes"), "heads", "joins", "marked"))
    joined = records.select(*key, "text").join(about, key, "left").select(*key, "text", "fixes", "heads", "joins", "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            name, record, text, fix, heads, joins, marked = (batch.column(i).to_pylist() for i in range(7))
            new = []
            for i, t in enumerate(text):
                f = {(x["what"], x.get("before") or ""): x["printed"] for x in json.loads(fix[i])} if fix[i] else {}
                noisy = bool(f or joins[i] or marked[i])
                new.append(repaired(t, name[i] == "weg_assets", Heads(heads[i], True) if heads[i] else None, f, set(joins[i] or ()), noisy) if t else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string()), pa.array([a != b for a, b in zip(text, new)])], ["table_name", "record_id", "text", "changed"])

    return joined.mapInArrow(run, "table_name string, record_id long, text string, changed boolean")
