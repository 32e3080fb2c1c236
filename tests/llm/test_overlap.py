import random
from collections import Counter
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermill.llm.overlap import GRAM, HITS, STRETCH, Overlap, _pair_counts, _signatures, apart, edit_distance, most_edits, plain_text, probes, rarest_runs
from ledgermill.llm.textarrays import gram_hashes, points

PROV = "record_id long, dataset string, source_split string, crop_sha256 string, raw_text string, loaded_at timestamp, role string, plain string, digest string"
ROLES = [("train", "train"), ("val", "validation"), ("test", "test"), ("train", "train")]


def overlap(spark, rows):
    rows = [(*r, datetime(2030, 1, 1), "x", "y", "z") for r in rows]
    return Overlap(spark.createDataFrame(rows, PROV), spark.createDataFrame(ROLES, "source_split string, split_role string"))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == levenshtein(a, b)


def test_enough_disjoint_runs_for_every_length():
    for n in range(40, 3000):
        worst = max(max(n, m) // 10 for m in range(40, n * 2) if abs(m - n) <= max(n, m) // 10)
        assert most_edits(n) == worst
        many, parts = worst + HITS, -(-n // STRETCH)
        for j in range(parts):
            assert GRAM * (many * (j + 1) // parts - many * j // parts) <= n * (j + 1) // parts - n * j // parts


def test_rarest_runs_are_disjoint_and_cheapest():
    rng = random.Random(1)
    costs = [np.array([rng.randint(0, 9) for _ in range(n - GRAM + 1)], float) for n in (40, 57, 90, 41)]
    counts = [most_edits(n) + HITS for n in (40, 57, 90, 41)]

    def least(cost, k, p=0):
        if not k:
            return 0
        return min((cost[i] + least(cost, k - 1, i + GRAM) for i in range(p, len(cost))), default=float("inf"))

    text, place = rarest_runs(costs, counts, GRAM)
    for i, (cost, k) in enumerate(zip(costs, counts)):
        got = place[text == i]
        assert len(got) == k and all(b - a >= GRAM for a, b in zip(got, got[1:]))
        assert cost[got].sum() <= cost[[GRAM * j for j in range(k)]].sum()
    small = [np.array([rng.randint(0, 9) for _ in range(22)], float) for _ in range(5)]
    text, place = rarest_runs(small, [3] * 5, GRAM)
    assert [small[i][place[text == i]].sum() for i in range(5)] == [least(c, 3) for c in small]


def test_probes_of_long_texts():
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(25_000))
    which, place = probes([gram_hashes(points(text), GRAM)], [len(text)], lambda g: (g % np.uint64(7)).astype(float))
    place = np.sort(place)
    assert len(place) == most_edits(len(text)) + HITS and (np.diff(place) >= GRAM).all() and place[-1] + GRAM <= len(text) and not which.any()


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=2, max_size=40), st.integers(0, 4), st.randoms())
def test_edits_spoil_two_character_pairs_at_most(text, edits, rng):
    other = list(text)
    for _ in range(edits):
        p = rng.randrange(len(other) + 1)
        other[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "ab"[: rng.randint(0, 1)]])
    other = "".join(other)
    common = np.minimum(_pair_counts([text]), _pair_counts([other])).sum()
    assert common >= max(len(text), len(other)) - 1 - 2 * levenshtein(text, other)


def test_signature_bound(spark):
    rng = random.Random(4)
    pairs = []
    for n in (5, 60, 200, 6000):
        a = "".join(rng.choice("abcdefghé 0123") for _ in range(n))
        b = list(a)
        for _ in range(rng.randint(0, n // 5)):
            b[rng.randrange(len(b))] = rng.choice(["", "q", "é1"])
        pairs += [(a, "".join(b)), (a, "zz" + a[::-1][: n // 2])]
    s, t = _signatures([a for a, _ in pairs]), _signatures([b for _, b in pairs])
    lacks = [max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) for a, b in pairs]
    names = [f"{x}{k}" for x in "ab" for k in range(4)]
    df = spark.createDataFrame([(i, lacks[i], *(int(x[i]) for x in (*s, *t))) for i in range(len(pairs))], "i int, n int, " + ", ".join(f"{x} long" for x in names))
    assert df.where(~apart("a", "b", F.col("n"))).count() == 0
    far = {r.i for r in df.where(~apart("a", "b", F.floor(F.col("n") / 3))).collect()}
    assert {3, 5} <= far  # half of each text is missing


def test_plain_text():
    assert plain_text("  Ünïté—12.5!\n ") == "unite 12 5" and plain_text(None) == ""


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    words = ["column", "smudged", "ruler", "sheet", "Tabri", "47.2", "row", "ink", "été", "page"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(7, 25))) for _ in range(40)]
    rows, n = [], 0
    for t in base:
        for split in ("train", "val", "TEST ", "other", None):
            s = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 8))):
                p = rng.randrange(len(s))
                s[p : p + 1] = rng.choice([["q"], [], [s[p], "z"]])
            n += 1
            rows.append((n, "d", split, rng.choice([None, "", " SHA256:AB", "ab", f"h{n}"]), "".join(s)))
    rows += [rows[0], (None, "d", "train", "ab", base[0]), (n + 1, None, "train", None, None), (n + 2, "d", "test", " ", "")]
    role = {"train": "train", "val": "validation", "test": "test"}
    full = [(r[0], role.get((r[2] or "").strip().lower(), "none"), (r[3] or "").strip().lower().removeprefix("sha256:"), plain_text(r[4])) for r in rows if r[0]]
    want = set()
    for a in full:
        for b in full:
            if a[1] == "train" and b[1] in ("validation", "test"):
                close = min(len(a[3]), len(b[3])) >= 40 and levenshtein(a[3], b[3]) <= max(len(a[3]), len(b[3])) // 10
                if (a[2] and a[2] == b[2]) or close:
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    o = overlap(spark, rows)
    assert {tuple(r) for r in o.pairs().collect()} == want
    assert sum(r.n_records for r in o.report().collect()) == len({r[0] for r in full if r[1] in ("validation", "test")})


def test_containment_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(60))
    part = " ".join(f"w{i}" for i in range(10, 40))
    rows = [(1, "d", "train", None, long), (2, "d", "test", None, part), (3, "d", "val", None, part.replace("w25", "xx")), (4, "d", "val", None, " ".join(f"v{i}" for i in range(30)))]
    got = {r.record_id: r.containment for r in overlap(spark, rows).contained_records().collect()}
    assert got == {2: 1.0, 3: round(21 / 26, 6)}


def test_containment_of_few_long_words(spark):
    few = "donaudampfschifffahrt kapitaensmuetzenband ueberpruefung"
    rows = [(1, "d", "train", None, f"one two three {few} four five six"), (2, "d", "test", None, few), (3, "d", "val", None, "a" * 45), (4, "d", "train", None, "b " + "a" * 45)]
    assert {r.record_id: r.containment for r in overlap(spark, rows).contained_records().collect()} == {2: 1.0, 3: 1.0}


def test_empty_and_long(spark):
    o = overlap(spark, [])
    assert o.pairs().collect() == [] and o.report().collect() == [] and o.contained_records().collect() == []
    text = "x y z " * 4000
    got = overlap(spark, [(1, "d", "train", None, text), (2, "d", "test", None, text + " end")]).pairs().collect()
    assert [tuple(r) for r in got] == [(1, 2)]
