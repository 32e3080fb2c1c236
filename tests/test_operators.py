import itertools
import math
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import answers, checks, ctc, export, islands, jobs, ranking, store, templates
from ledgermill.sources import readers


def test_outlier_row(spark):
    values = [11.3, 26.2, 24.2, 18.7, 20.5, 19.8, 51.2, 97.2, 56.7, 46.7]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)] + [(2, i, float(i * 100)) for i in range(4)] + [(3, 0, None)], "g int, i int, v double")
    got = checks.outliers(df, ["g"], F.col("v"))
    assert [r.i for r in got.where("is_outlier").collect()] == [7] and got.where("g = 2").count() == 0


def test_ranking_golden(spark):
    ev = [(1, m, "base-0", v, s) for m in "abc" for v, s in (("21.4", 0.8), ("27.4", 0.3))] + [(2, m, "base-0", v, s) for m in "abc" for v, s in (("21.4", 0.81), ("27.4", 0.80))]
    ev += [(1, "a", "base-0", "21.4", 0.8), (None, "a", "base-0", "1", 0.1), (1, "a", None, None, None)]
    e = spark.createDataFrame(ev, "cell_id long, model string, image_key string, value_text string, support double")
    o = spark.createDataFrame([(1, "27.4", ["21.4"]), (2, "27.4", ["21.4"]), (3, "x", None)], "cell_id long, text string, candidates array<string>")
    d = spark.createDataFrame([], "cell_id long, text string, support double")
    got = {r.cell_id: (r.selected, r.flags) for r in ranking.rank(e, o, d).collect()}
    assert got[1] == ("21.4", "candidate_reranked") and got[2][0] == "27.4" and "candidate_ranking_disagreement" in got[2][1] and 3 not in got


def test_visible_digits_lower_short_values(spark):
    ev = spark.createDataFrame([(1, m, "base-0", v, s) for m in "abc" for v, s in (("21.4", 0.6), ("2.4", 0.8))], "cell_id long, model string, image_key string, value_text string, support double")
    o = spark.createDataFrame([(1, "2.4", ["21.4"])], "cell_id long, text string, candidates array<string>")
    d = spark.createDataFrame([], "cell_id long, text string, support double")
    seen = spark.createDataFrame([(1, None, 3)], "cell_id long, separator double, digits int")
    assert [r.selected for r in ranking.rank(ev, o, d).collect()] == ["2.4"] and [(r.selected, r.score) for r in ranking.rank(ev, o, d, seen).collect()] == [("21.4", 0.6)]


def test_settled_digits(spark):
    ties = spark.createDataFrame([(i, "27.4", "21.4", 2, c) for i, c in ((1, "21.4"), (2, "21.4"), (3, "27.4"), (4, "99"), (5, "27.4"), (6, "27.4"))], "cell_id long, first string, second string, position int, current string")
    said = {1: [("7", 0.25), ("7", 0.5), ("7", 0.9)], 2: [("7", 0.24), ("7", 0.9), ("7", 0.9)], 3: [("7", 0.9)] * 3, 4: [("7", 0.9)] * 3, 5: [("7", 0.9)] * 2, 6: [("3", 0.9)] * 3}
    glyphs = spark.createDataFrame([(i, t, c) for i, x in said.items() for t, c in x] + [(None, "7", 0.9)], "cell_id long, text string, confidence double")
    got = {r.cell_id: (r.selected, r.flags) for r in ranking.settled_digits(ties, glyphs).collect()}
    assert got == {1: ("27.4", "isolated_digit_consensus,candidate_reranked"), 2: ("21.4", "isolated_digit_disagreement"), 3: ("27.4", "isolated_digit_consensus"), 6: ("27.4", "isolated_digit_disagreement")}


def test_adaptive_gate(spark):
    views = [(m, v) for m in "ab" for v in ("base-0", "base-1")]
    def cell(i, value, support=0.97, rival=None):
        return [(i, m, v, value, support) for m, v in views] + ([(i, "a", "base-0", "9", rival)] if rival else [])
    ev = cell(1, "12") + cell(2, "12", 0.94) + cell(3, "12", rival=0.096) + cell(4, "12", rival=0.098) + cell(5, "1.2") + cell(6, "1.2") + cell(7, "12") + cell(8, "300") + cell(9, "12")[:3]
    rule = ("numeric", None, 200.0, None, None, None, 100.0, True, False, False, False)
    kinds = "struct<value_format:string,minimum:double,maximum:double,decimal_places:int,allowed_values:array<string>,expected_minimum:double,expected_maximum:double,allow_empty:boolean,suggest_missing_decimal:boolean,prefer_expected_range:boolean,require_decimal:boolean>"
    obs = spark.createDataFrame(ev, "cell_id long, model string, image_key string, value string, support double")
    rules = spark.createDataFrame([(i, rule) for i in range(1, 10)], f"cell_id long, rule {kinds}")
    seen = spark.createDataFrame([(5, 0.7, 2), (6, 0.6, 2), (7, None, 3)], "cell_id long, separator double, digits int")
    assert {r.cell_id for r in ranking.adaptive(obs, rules, seen).where("pass = 'short'").collect()} == {1, 3, 5}


def paths(matrix, alphabet, text):
    total = 0.0
    for path in itertools.product(range(len(alphabet)), repeat=len(matrix)):
        out = "".join(alphabet[i] for i, _ in itertools.groupby(path) if i)
        if out.replace(",", ".") == text:
            total += math.prod(matrix[t][i] for t, i in enumerate(path))
    return math.log(total)


def test_ctc_forward_against_all_paths():
    alphabet = ["", "3", "4", ".", ","]
    matrix = np.random.default_rng(7).dirichlet(np.ones(5), 5)
    for text in ("34.4", "3", "33", "4.3", ""):
        assert abs(ctc.forward(matrix, alphabet, text) - paths(matrix, alphabet, text)) < 1e-9


RULE = "struct<value_format:string,minimum:double,maximum:double,decimal_places:int,allowed_values:array<string>,allow_empty:boolean,require_decimal:boolean>"


def decode(spark, matrix, alphabet, rule, **sizes):
    df = spark.createDataFrame([(1, [[float(x) for x in row] for row in matrix], alphabet, rule)], f"key long, probabilities array<array<double>>, characters array<string>, rule {RULE}")
    return [(r.text, r.log_probability, r.confidence) for r in ctc.decoded(df, **sizes).orderBy("rank").collect()]


def test_beam_against_all_paths(spark):
    alphabet = ["", "3", "4", ".", "I"]
    for seed in range(4):
        matrix = np.random.default_rng(seed).dirichlet(np.full(5, 0.6), 5)
        best = decode(spark, matrix, alphabet, ("numeric", 0.0, 100.0, 1, None, True, True), width=500)
        texts = [a + "." + b for n in (1, 2, 3) for a in map("".join, itertools.product("34", repeat=n)) for b in "34"]
        want = sorted(((t, paths(matrix, alphabet, t)) for t in texts if float(t) <= 100 and len(t) <= 5), key=lambda x: (-x[1], x[0]))
        want = [(t, s) for t, s in want if s > math.log(1e-25)]
        assert [t for t, *_ in best] == [t for t, _ in want][:8]
        assert all(abs(s - w) < 1e-6 and abs(c - math.exp(w / 5)) < 1e-6 for (_, s, c), (_, w) in zip(best, want))
    sharp = np.full((4, 5), 0.01)
    for t, c in enumerate(("3", "4", ".", "4")):
        sharp[t, alphabet.index(c)] = 0.9
    found = [t for t, *_ in decode(spark, sharp, alphabet, ("numeric", 0.0, 100.0, 1, None, True, False))]
    assert found[0] == "34.4" and "344" not in found


def test_beam_with_listed_texts(spark):
    alphabet = ["", *"n.d12,−"]
    matrix = np.full((4, len(alphabet)), 0.05)
    for t, c in enumerate("n.d"):
        matrix[t, alphabet.index(c)] = 0.6
    assert [t for t, *_ in decode(spark, matrix, alphabet, ("text", None, None, None, ["n.d", "1"], True, False))][0] == "n.d"
    assert {t for t, *_ in decode(spark, matrix, alphabet, ("numeric", None, None, None, ["1,2", "−2"], True, False))} == {"1.2", "-2"}
    assert decode(spark, [], alphabet, ("numeric", None, None, None, None, True, False)) == []


def test_prefixes_of_rules():
    opens = lambda rule, text: ctc.compiled(*rule).fullmatch(text, partial=True) is not None
    free, bounded, whole = ("numeric", None, None, None, ()), ("numeric", 0.0, 70.5, 1, ()), ("integer", -5.0, None, None, ())
    assert all(opens(free, t) for t in ("", "-", "+1", "1234567890", "1.", "0.123456")) and not any(opens(free, t) for t in (".", "--", "1..", "12345678901", "x"))
    assert all(opens(bounded, t) for t in ("+", "0070", "70.5")) and not any(opens(bounded, t) for t in ("-", "70.55", "00070"))
    assert opens(whole, "-005") and not any(opens(whole, t) for t in ("5.", "-0005"))


def test_answers(spark):
    said = [
        ("| 12 | 3,5 |", 2, ["12", "3,5"]), ("12,3 | 45,6", 2, ["12,3", "45,6"]), ("['1', 2]", 2, ["1", "2"]), ("[1, 2]", 3, None), ("[true, null]", 2, ["true", None]), ('[{"a": 1}, "x"]', 2, ['{"a":1}', "x"]), ("['it\\'s', None]", 2, ["it's", None]), ("['a' 'b']", 2, None),
        ("<table><tr><td>1</td><td><b>2.5</b></td></tr></table>", 2, ["1", "2.5"]), ("<tr><th></th><th>1</th><th>2</th></tr>", 2, ["1", "2"]), ("<tr><td>1</td></tr><tr><td>2</td></tr>", 2, ["1", "2"]), ("<tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr>", 2, None),
        ("<tr><td>1</td><td>2</td></tr><tr><td>1</td><td>2</td></tr>", 2, ["1", "2"]), ("<td>a &amp; b</td>", 1, ["a & b"]), ("<td>1<table></td>", 1, None), ("```json\n[\"1\"]\n```", 1, ["1"]), ("\\(1\\) $2$", 2, ["1", "2"]),
        ("a 1 b", 1, None), ("12.3 45.6 extra", 2, None), ("12.3 45.6 7.8", 2, None), ("12 . 3 & 4", 2, ["12.3", "4"]), (None, 1, None), ("", 1, None), ("[", 1, None),
    ]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(said)], "i int, t string, n int").select("i", answers.row_values(F.col("t"), F.col("n")).alias("v"))
    got = {r.i: r.v for r in df.collect()}
    assert {i: (said[i][0], got[i]) for i in got} == {i: (t, v) for i, (t, _, v) in enumerate(said)}
    rows = [("[{\"row\":1,\"values\":[\"1\",\"2\"]},{\"row\":2,\"values\":[\"1\"]},{\"row\":3,\"values\":[\"3\",\"4\"]},{\"row\":3,\"values\":[\"3\",\"5\"]},{\"row\":9,\"values\":[\"0\",\"0\"]}]",), ("oops",), (None,)]
    df = spark.createDataFrame(rows, "a string")
    got = df.select(answers.table_rows(F.col("a"), F.lit(5), F.lit(2)).alias("t")).collect()
    assert [[(x.row, list(x["values"])) for x in r.t] for r in got] == [[(1, ["1", "2"])], [], []]


def test_regular_lattice(spark):
    even = [20 * i for i in range(12)]
    jitter = [y + (i % 3) - 1 for i, y in enumerate(even)]
    cases = [
        (even, even, False), (even[:5], even[:5], False), ([y for y in even if y != 100], even, True), ([y for y in jitter if y not in (101, 161)], None, True), (sorted([*even, 51]), even, True),
        ([0, 60, *(60 + 20 * i for i in range(1, 12))], None, False), ([5 * i for i in range(12)], None, False), (None, None, None), ([], [], False),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, l array<int>").select("i", islands.regular_lattice(F.col("l")).alias("x"))
    for r in df.collect():
        given, want, rebuilt = cases[r.i]
        assert r.x.lines == (want if want is not None else r.x.lines) and (rebuilt is None or r.x.rebuilt == rebuilt), r.i
        if rebuilt is False:
            assert r.x.lines == given
        if r.i == 3:
            assert len(r.x.lines) == 12 and all(abs(a - b) <= 1 for a, b in zip(r.x.lines, even)) and set(given) <= set(r.x.lines)


def test_reading_order(spark):
    boxes = [
        ("t", "c", 50, 0, 80, 12), ("t", "a", 0, 2, 20, 10), ("t", "b", 22, 1, 48, 30), ("t", "d", 0, 14, 30, 22), ("t", "e", 40, 15, 60, 23), ("t", "f", 5, 40, 9, 44), ("u", "x", 0, 0, 1, 1), ("u", "n", None, 0, 1, 1),
    ]
    got = store.reading_order(spark.createDataFrame(boxes, "k string, box_id string, left int, top int, right int, bottom int"), "k").orderBy("k", "place").collect()
    assert [(r.k, r.box_id, r.place) for r in got] == [("t", x, i) for i, x in enumerate("abcdef")] + [("u", "x", 0)]


def test_captions(spark):
    df = spark.createDataFrame([("Date:  14.03", "Date"), ("date 3 Date", "Date"), ("Testing", "Test"), ("Test ing", "Test"), ("x", ""), (None, "Date"), ("No. 7", "No."), ("No.7", "No.")], "t string, l string")
    assert [r[0] for r in df.select(store.strip_caption(F.col("t"), F.col("l"))).collect()] == ["14.03", "3 Date", "Testing", "ing", "x", "", "7", "7"]


def test_names_are_free(spark):
    stems = ["a"] * 4 + ["a-2", "a-2", "a-3-2", "a-10", "b-01", "b", "b"]
    jobs_ = spark.createDataFrame([(f"j{i}", s + ".pdf") for i, s in enumerate(stems)], "id string, source_name string")
    names = [r.file_name for r in export.export_names(jobs_).collect()]
    assert len(set(names)) == len(stems) and {"a.xlsx", "a-3.xlsx", "a-4.xlsx", "a-5.xlsx", "a-2.xlsx", "a-2-2.xlsx", "b.xlsx", "b-2.xlsx"} <= set(names)


def test_islands(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 10, 11, 30)] + [(1, None)], "g int, v int")
    assert sorted((r.first, r.center, r.n) for r in islands.clusters(df, "g", "v", 3).collect()) == [(1, 2, 3), (10, 10, 2), (30, 30, 1)]
    cells = spark.createDataFrame([("t", r, c) for r in (0, 1) for c in (0, 1, 3)] + [("t", 0, 0)], "k string, r int, c int")
    assert sorted(tuple(r) for r in islands.rectangles(cells, "k", "r", "c").collect()) == [("t", 0, 1, 0, 1), ("t", 0, 1, 3, 3)]


def test_queue_fold(spark):
    events = [(1, 1, 1, "enqueue"), (1, 2, 2, "start"), (1, 3, 3, "enqueue"), (1, 4, 4, "complete"), (1, 5, 5, "review"), (1, 6, 6, "export"), (2, 1, 1, "start"), (None, 1, 1, "start"), (3, 1, 2, "start"), (3, 1, 1, "enqueue")]
    got = {r.job_id: (r.state, r.n_illegal) for r in jobs.fold(spark.createDataFrame(events, "job_id long, at int, seq int, event string")).collect()}
    assert got == {1: ("exported", 1), 2: ("", 1), 3: ("running", 0)}


def test_uploads(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), (None, "z")], "upload_id string, sha256 string")
    receipts, conflicts = jobs.uploads(df)
    assert [tuple(r) for r in receipts.collect()] == [("a", "x", 2)] and [tuple(r) for r in conflicts.collect()] == [("b", 2)]


def test_imported_twice(spark):
    """Sorted merges, as at size: the union of the first import was taken for partitioned by id in the second."""
    row = "id string, source_name string, source_path string"
    j = spark.createDataFrame([("a", "old", "/o", "ready", "1", 1), ("a", "newer", "/n", "review", "2", 1), ("b", "b", "/b", "ready", "1", 1), (None, "x", "/x", "ready", "1", 1)], row + ", status string, updated_at string, received_at int")
    s = spark.createDataFrame([("a", "again", "/s"), ("c", "c1", "/c1"), ("c", "c2", "/c2"), ("d", None, ""), (None, "y", "/y")], row)
    added = [("c", "c1", "/c1", "imported"), ("c", "c2", "/c2", "imported"), ("d", None, "", "imported")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = jobs.imported(jobs.current(j), s)
        for got in (once, jobs.imported(once, s), jobs.imported(jobs.imported(once, s), s)):
            assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "newer", "/n", "review"), ("b", "b", "/b", "ready"), *added], key=str)
        assert sorted(map(tuple, jobs.imported(jobs.current(j.limit(0)), s.where("id > 'a'")).collect()), key=str) == sorted(added, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_titles(spark):
    df = spark.createDataFrame([("Plantar test, left", "Plantar Test"), ("Plantartest", "plantar test"), ("a b", "a b"), (None, "plantar"), ("x", None)], "t string, n string")
    assert [r[0] for r in df.select(templates.title_matches(F.col("t"), F.col("n"))).collect()] == [True, False, False, False, False]


def test_workbook(tmp_path):
    path = str(tmp_path / "book.xlsx")
    export.write_workbook(path, {"Data": (["a", "b"], [("=1+1", 2.5), (None, "<x>")])})
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    broken = iter([("x",)])

    def rows():
        yield from broken
        raise ValueError("stopped")

    with pytest.raises(ValueError):
        export.write_workbook(path, {"Data": (["a"], rows())})
    with zipfile.ZipFile(path) as z:
        assert z.read("xl/worksheets/sheet1.xml").decode() == sheet and os.listdir(tmp_path) == ["book.xlsx"]
    assert "inlineStr" in sheet and "=1+1" in sheet and "<v>2.5</v>" in sheet and "&lt;x&gt;" in sheet


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"id": "a", "name": "A", "row_guides": [0, 0.5, 1], "column_guides": [0, 1], "future": 1}')
    (tmp_path / "t" / "b.json").write_text('{"id": "b", "row_gui')
    got = readers.templates(spark, str(tmp_path / "t")).collect()
    assert [(r.id, r.header_rows, r.schema_version, r.family_id, r.cell_rules) for r in got] == [("a", 1, 1, "a", [])]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(9) for _ in range(2)))) + chunk(b"IEND", b"")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.png").write_bytes(png)
    (tmp_path / "p" / "y.txt").write_text("no")
    page = readers.pages(spark, str(tmp_path / "p")).drop("data").collect()
    assert [(r.height, r.width, r.channels) for r in page] == [(2, 3, 3)]
    files = readers.files(spark, str(tmp_path / "p"))
    assert sorted(r.kind for r in files.collect()) == ["png", "unknown"] and readers.openable(files).count() == 1
    before = spark.createDataFrame([(r.path, r.length, r.digest) for r in files.collect()], "path string, length long, digest string")
    (tmp_path / "p" / "y.txt").unlink()
    (tmp_path / "p" / "z.jpg").write_bytes(png)
    (tmp_path / "p" / "x.png").write_bytes(png[:-1] + b"x")
    after = readers.files(spark, str(tmp_path / "p"))
    assert {(r.path[-5:], r.change) for r in readers.changed(before, after).collect()} == {("x.png", "changed"), ("y.txt", "gone"), ("z.jpg", "new")}
    assert [r.path[-5:] for r in readers.misnamed(after).collect()] == ["z.jpg"]
