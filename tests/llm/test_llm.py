"""The text operators, held against plain versions of themselves."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import codes, leaks, mix, scans, spans, split

WORDS = "alpha beta gamma delta kilo lima Mike november Oscar papa 12 345 über 機場 x".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".", ".\n", "\n\n", "\r\n", ""]) for _ in range(n))


# pieces


@pytest.mark.parametrize("seed", range(4))
def test_pieces_give_the_text_back(seed):
    r = random.Random(seed)
    for _ in range(60):
        t = r.choice([prose(r, r.randint(0, 400)), "字，" * r.randint(0, 900), "x" * r.randint(0, 2000), "\r\n" * 400, " \t\n" * 300, "\r" * 900, prose(r, 60) + "y" * 700 + prose(r, 60)])
        limit, overlap = r.choice([(200, 20), (50, 0), (300, 149), (7, 6)])
        p = split.pieces(t, limit, overlap)
        assert all(b - a <= limit for a, b, _ in p)
        assert all(b == c + overlap for (_, b, _), (c, _, _) in zip(p, p[1:]))
        assert t[: p[0][1]] + "".join(t[a + overlap : b] for a, b, _ in p[1:]) == t
        assert p[-1][1] == len(t) and [x[2] for x in p].count("end") == 1


def test_cuts_prefer_strong_boundaries():
    text = "One two three. Four five.\n\nSix seven eight nine ten eleven twelve thirteen."
    assert split.pieces(text, 40, 5)[0] == (0, 27, "paragraph")
    assert split.pieces("a b. " + "c" * 8 + " d e f g h", 20, 2)[0][2] == "word"
    assert split.pieces("A bc. De fg hi. " + "k" * 30, 20, 2)[0] == (0, 16, "sentence")
    assert split.pieces("z" * 50, 20, 2)[0] == (0, 20, "hard")


def test_paragraphs_are_runs_of_lines():
    t = " \t\r\nab\r\ncd\n\t \nef\r\n \r\n\r\ngh\r"
    o = split.Offsets(t)
    assert [(t[a:b], int(o.sums[b] - o.sums[a])) for a, b in zip(o.first, o.last)] == [("ab\r\ncd", 5), ("ef", 2), ("gh\r", 3)]
    assert [o.oversized(n).tolist() for n in (5, 4, 2, 1)] == [[], [0], [0, 2], [0, 1, 2]]


def test_oversized_paragraphs_equal_a_count_of_lines():
    r = random.Random(8)
    for _ in range(400):
        t = "".join(r.choice(["ab", "x y", " ", "\t", "\r\n", "\n", "\n\n", "\r", "字", "\r\n\r\n"]) for _ in range(r.randint(0, 40)))
        want, block, n = [], 0, 0
        for line in [*t.replace("\r\n", "\n").split("\n"), ""]:
            if line.strip(" \t"):
                block, n = block + (n == 0), n + len(line) + 1
            else:
                want += [block - 1] if n - 1 > 6 else []
                n = 0
        assert split.Offsets(t).oversized(6).tolist() == want, repr(t)


def test_split_records(spark):
    big = "p " * 900
    rows = [("t", 1, "short\n\n" + big + "\n\nend"), ("t", 1, "short\n\n" + big + "\n\nend"), ("t", 2, None), ("t", 3, ""), ("t", 4, "x"), ("u", None, "y" * 1501), ("t", 5, "a" * 1000 + "\n\n" + "b" * 1000)]
    df = spark.createDataFrame(rows, "table_name string, record_id long, text string").withColumn("start", F.lit("clash"))
    assert {tuple(x) for x in split.oversized_paragraphs(df).collect()} == {("t", 1, 2), ("u", None, 1)}
    got = split.split_records(df).filter("record_id = 5").orderBy("piece_no").collect()
    assert [(x["piece_no"], x["start"], x["stop"], x["cut"]) for x in got] == [(1, 0, 1002, "paragraph"), (2, 852, 2002, "end")]
    assert split.split_records(df, all_records=True).filter("record_id = 4").first()["text"] == "x"
    assert split.split_records(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_records(df, 10, 10)


# shared spans


def shared(rows, n):
    where = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    pairs = {p for ids in where.values() for p in itertools.combinations(sorted(ids), 2)}
    cover = {}
    for i, t in rows:
        mark = bytearray(len(t or ""))
        for k in range(len(mark) - n + 1):
            if len(where[t[k : k + n]]) > 1:
                mark[k : k + n] = b"\1" * n
        cover[i] = sum(mark)
    return pairs, cover


@pytest.mark.parametrize("hot", [64, 3])
def test_shared_text_equals_all_windows(spark, hot):
    r = random.Random(hot)
    blocks = [prose(r, 25) for _ in range(8)]
    head = prose(r, 12)
    rows = [(i, (head if i % 2 else "") + prose(r, r.randint(0, 40)) + "".join(r.choice(blocks) + prose(r, 5) for _ in range(r.randint(0, 2)))) for i in range(60)]
    rows += [(100 + i, "same text " + blocks[0]) for i in range(6)] + [(200, None), (201, ""), (202, "ab" * 500), (203, "ab" * 300), (204, "\U0001f600" * 90), (205, "x\U0001f600" * 90)]
    n = 60
    pairs, cover = shared(rows, n)
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").withColumn("pos", F.lit("clash")).repartition(3)
    assert {tuple(x) for x in spans.shared_pairs(df, n, hot).collect()} == pairs
    got = {x["doc_id"]: x["shared_chars"] for x in spans.shared_share(df, n, hot).collect()}
    assert got == cover


def test_a_full_sketch_changes_no_result_and_no_volume(spark):
    r = random.Random(5)
    block = prose(r, 40)
    rows = [(i, prose(r, 60) + (block if i % 3 == 0 else "")) for i in range(45)]
    pairs, cover = shared(rows, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wide, full = spans.repeated_anchors(df, 60, 8), spans.repeated_anchors(df, 60, 8, k=4)
    assert spans.repeated_cells(spans.anchor_lists(df, 60), 4).count() == 2 * 16
    assert sorted(map(str, wide.collect())) == sorted(map(str, full.collect()))
    assert {tuple(x) for x in spans.shared_pairs(df, 60, 8, k=4).collect()} == pairs
    got = {x["doc_id"]: x["stop"] - x["start"] for x in spans.shared_spans(df, 60, 8, k=4).collect()}
    assert got == {i: n for i, n in cover.items() if n}


def test_spans_of_texts_longer_than_a_segment(spark):
    r = random.Random(9)
    long = "".join(chr(97 + r.randrange(26)) for _ in range(1_200_000))
    rows = [(1, long), (2, long[524_200:524_500]), (3, long[:400] + "#" + long[-400:]), (4, long[700_000:700_299])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in spans.shared_pairs(df).collect()} == {(1, 2), (1, 3)}
    got = {(x["doc_id"], x["start"], x["stop"]) for x in spans.shared_spans(df).collect()}
    assert got == {(1, 0, 400), (1, 524_200, 524_500), (1, 1_199_600, 1_200_000), (2, 0, 300), (3, 0, 400), (3, 401, 801)}


def test_spans_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(df).count() == spans.shared_share(df).count() == 0


def test_window_hashes():
    x = np.array([5, 1, 7, 7, 2, 9, 1], dtype=np.uint64)
    assert codes.sliding_min(x, 3).tolist() == [1, 1, 2, 2, 1]
    p = codes.prefix_hash(codes.code_points("abcXabcYabc"))
    h = codes.window_hash(p, 3)
    assert h[0] == h[4] == h[8] and len(set(h.tolist())) == len(h) - 2


# leaks


def test_leaks_equal_a_search_for_word_runs(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["a", "I", "Éa", "中文"]
    quotes = [" ".join(r.choice(vocabulary) for _ in range(r.randint(8, 40))) for _ in range(40)]
    cases = [(f"q{i}", [("s", 1, q), ("s", 2, None)] if i % 7 else None) for i, q in enumerate(quotes)] + [("q1", [("s", 1, quotes[1])]), (None, [("s", 1, "x " * 20)])]
    seps = [" ", "  ", "\n", " - ", "…", "_"]
    docs = []
    for i in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        q = r.choice(quotes).split()
        a = r.randrange(len(q))
        w[r.randint(0, len(w)) : 0] = [x.upper() if r.random() < 0.3 else x for x in q[a : a + r.randint(5, 30)]]
        docs.append((i, "".join(x + r.choice(seps) for x in w)))
    docs += [(900, None), (901, ""), (902, quotes[2] * 3), (903, "z " * 200_000 + quotes[3] + " z" * 200_000)]
    word = re.compile(r"[^\W_]+")
    runs = {}
    for i, e in cases:
        for x in e or []:
            w = word.findall((x[2] or "").lower())
            for k in range(len(w) - 11):
                if i:
                    runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for i, t in docs:
        w = word.findall((t or "").lower())
        for k in range(len(w) - 11):
            want |= {(i, c) for c in runs.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("id", F.lit("clash"))
    c = spark.createDataFrame(cases, "id string, expected array<struct<source:string,page:int,quote:string>>")
    assert {tuple(x) for x in leaks.leaked_documents(d, c).collect()} == want
    some = leaks.leaked_passages(d, c)
    assert {(x["doc_id"], x["id"]) for x in some.filter("common_words >= 12").collect()} == want
    assert leaks.leaked_documents(d.limit(0), c).count() == leaks.leaked_documents(d, c.limit(0)).count() == 0


def test_an_edited_passage_is_aligned(spark):
    q = "the quick brown fox jumps over the lazy dog while seventeen cats watch from a distant wall"
    edited = q.replace("jumps", "jumqs")
    d = spark.createDataFrame([(1, "Before this. " + edited + " After that."), (2, "nothing of it at all here")], "doc_id long, text string")
    c = spark.createDataFrame([("q", [("s", 1, q)])], "id string, expected array<struct<source:string,page:int,quote:string>>")
    (x,) = leaks.leaked_passages(d, c).collect()
    assert (x["doc_id"], x["edits"], x["start"], x["stop"]) == (1, 1, 12, 12 + len(q))
    assert x["common_words"] == len(q.split()[5:])


# mixing


def test_mix(spark):
    rows = [(i, "one two three four five", "a") for i in range(400)] + [(1000 + i, "six seven", "b") for i in range(5)] + [(2000, None, "a"), (2001, "", None), (2002, "lost words", None), (2003, "other", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 9), (None, 0.2, 1), ("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    counts = mix.token_counts(docs)
    n = {x["doc_id"]: x["tokens"] for x in counts.collect()}
    assert n[0] == 5 and n[1000] == 2 and n[2000] == n[2001] == 0
    rates = {x["source"]: x for x in mix.source_rates(counts, targets).collect()}
    total = sum(n.values())
    assert set(rates) == {"a", "b", "none"} and rates["a"]["wanted"] == pytest.approx(0.25 * total)
    assert (rates["a"]["short"], rates["b"]["short"], rates["none"]["short"]) == (False, True, True) and rates["b"]["rate"] == 3.0
    used = mix.source_rates(counts, targets)
    one = sorted((x["doc_id"], x["copy"], x["text"]) for x in mix.mixed_documents(docs, used).collect())
    assert one == sorted((x["doc_id"], x["copy"], x["text"]) for x in mix.mixed_documents(docs.repartition(3), used).collect())
    assert [x for x in one if x[0] == 1002] == [(1002, i, "six seven") for i in (1, 2, 3)]
    one = {x[0] for x in one}
    assert 2000 not in one and 2001 not in one and 2003 not in one
    got = sum(5 for i in one if i < 400)
    assert abs(got - rates["a"]["wanted"]) < 0.2 * rates["a"]["wanted"]
    share = {x["source"]: x["share"] for x in mix.reached_shares(counts, targets).collect()}
    assert sum(share.values()) == pytest.approx(1, abs=1e-5) and share["none"] == 0
    assert mix.reached_shares(mix.token_counts(docs.limit(0)), targets).count() == 3
    assert mix.source_rates(counts, targets.limit(0)).count() == 0


# scans


def test_confusions():
    assert scans.confusion_weight("before", "bef0re") == 0.4 and scans.confusion_weight("ledger", "ledqer") is None
    assert scans.confusion_weight("marked", "markecl") == 0.5 and scans.confusion_weight("draarvik", "droorvik") == 1.0
    assert scans._weight("ostarnn", "ostarrin") == 0.6 and scans._weight("cat", "cat") == 0.0
    row, h = scans.deletion_hashes(["abc", "ac", "c", "", "aXYc", "b" * 50_000])
    of = [set(h[row == i].tolist()) for i in range(6)]
    assert [len(x) for x in of] == [6, 4, 2, 1, 8, 3]
    assert len(of[0] & of[1]) == 3 and len(of[0] & of[2]) == 1 and len(of[4] & of[1]) == 2 + 1 - 0 - 0 or len(of[4] & of[1]) >= 1
    assert scans.confusion_weight("e" + "x" * 5000 + "e", "c" + "x" * 5000 + "c") == 1.0


def test_page_number_lines():
    for s in ("[12]", "Page 12", "PAGE 12.", "12 |", "- 12 -", "— 12 —", "12 of 300", "12 / 300", ". 12", "p. l2", "A-12", "1 2", "xiv", "12", "Seite 9"):
        assert scans.page_number_lines(["text here", s], False) or scans.page_number_lines([s], True), s
    for s in ("1987.", "1,234.", "On hand", "GW-687 waited", "A-", "lo", "came later in 1987."):
        assert not scans.page_number_lines([s], True), s
    assert scans.page_number_lines(["a", "b", "c", "12", "d", "e", "f"], False) == []
    assert scans.page_number_lines(["On hand", "12", "13"], False) == []


def scanned(spark):
    r = random.Random(6)
    nouns = "harbour station depot antenna machine engine battery section garrison turbine".split()
    verbs = "carried repaired inspected modified delivered".split()

    def sentence():
        return f"The {r.choice(nouns)} {r.choice(verbs)} the hand-built {r.choice(nouns)} near {r.choice(['Torvik', 'Zinmoor'])} in 19{r.randint(10, 99)}."

    rows, truth = [], {}
    for page in range(1, 121):
        body = [sentence() for _ in range(12)]
        if page <= 60:
            rows.append(("rag_parents", page, "clean.pdf", page, "\n".join(body)))
            continue
        kinds, lines = set(), list(body)
        if page % 2:
            lines.insert(0, f"Handbook of Quiet Stations — sheet {page}" if page % 3 else "HANDBOOK OF QUIET STATIONS")
            kinds.add("header")
        if page % 3 == 0:
            lines.append(f"[{page}]")
            kinds.add("pageno")
        if page % 4 == 0:
            lines[3] = "The garr-\nison repaired the hand-\nbuilt engine near Torvik in 1950."
            kinds.add("hyphen")
        if page % 5 == 0:
            lines[4] = "The statiou repaired the hand-built bat1ery near Torvik in l950." if page % 2 else "The harbonr repaired the antcnna near Zinmoor in 1950."
            kinds.add("misread")
        rows.append(("rag_parents", page, "scan.pdf", page, "\n".join(lines)))
        truth[page] = kinds
    return rows, truth


def test_noise_kinds_and_repair(spark):
    rows, truth = scanned(spark)
    more = [("rag_parents", 900, "scan.pdf", 900, None), ("rag_parents", 901, None, None, ""), ("weg_assets", 902, "notes", None, "The depot carried the engine near Torvik in 1950.\n17\nThe turbine inspected the depot near Torvik in 1951.")]
    df = spark.createDataFrame(rows + more + rows[:3], "table_name string, record_id long, source string, page int, text string").withColumn("what", F.lit("clash"))
    got = {}
    for x in scans.noise_kinds(df).collect():
        got.setdefault(x["record_id"], set()).add(x["noise_kind"])
    assert got.pop(902) == {"pageno"}
    assert got == {k: v for k, v in truth.items() if v}
    texts = {x["record_id"]: x for x in scans.repaired_texts(df).collect()}
    assert all(not texts[i]["changed"] for i in range(1, 61)) and texts[900]["text"] is None
    t = texts[120]["text"]
    assert "garrison repaired the hand-built engine" in t and "antenna" in t and "[120]" not in t and "\n" not in t
    assert texts[75]["text"].startswith("The") and "station repaired" in texts[75]["text"] and "1950" in texts[75]["text"]
    assert scans.noise_kinds(df.limit(0)).count() == 0


def test_heads_inside_pages(spark):
    rows, truth = scanned(spark)
    n, clean = 200, [r for r in rows if r[3] <= 60]
    inside = {n: "HANDBOOK OF QUIET STATIONS", n + 1: "Handbook of Quict Stations — sheet 9"}
    for i, line in inside.items():
        body = clean[i - n][4].split("\n")
        rows.append(("rag_parents", i, "scan.pdf", i, "\n".join([*body[:6], line, *body[6:]])))
    # a head of another source only, and a head that stands at the edge of two pages of six
    rows.append(("rag_parents", 210, "clean.pdf", 210, rows[-1][4]))
    for i in range(220, 226):
        body = clean[i - 210][4].split("\n")
        at = 5 if i < 224 else 0
        rows.append(("rag_parents", i, "inner.pdf", i, "\n".join([*body[:at], f"Tables of the Western Canal — sheet {i}", *body[at:]])))
    df = spark.createDataFrame(rows, "table_name string, record_id long, source string, page int, text string")
    got = {x["record_id"] for x in scans.noise_kinds(df).filter("noise_kind = 'header'").collect()}
    assert got == {k for k, v in truth.items() if "header" in v} | {*inside, *range(220, 226)}
    texts = {x["record_id"]: x["text"] for x in scans.repaired_texts(df).collect()}
    assert all("andbook" not in texts[i] and "HANDBOOK" not in texts[i] for i in inside) and "Canal" not in texts[221]
    assert texts[200] == " ".join(clean[0][4].split("\n"))


def test_head_keys():
    r = random.Random(3)
    for _ in range(3000):
        s = "".join(r.choice("aBlIoOsS019 —-–.éß中²_") for _ in range(r.randint(1, 9)))
        assert scans.head_key(s) == "".join(c for c in scans._SHEET_END.sub("", scans._SHEET_START.sub("", s.strip())) if re.match(r"[^\W\d_]", c)).lower(), s
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(6, 9))) for _ in range(2))
        row = {(i, j): i + j for i in range(10) for j in range(10) if not i or not j}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                row[i, j] = min(row[i - 1, j] + 1, row[i, j - 1] + 1, row[i - 1, j - 1] + (x != y))
        assert all(scans.edits(a, b, k) == (row[len(a), len(b)] <= k) for k in (1, 2, 3))
