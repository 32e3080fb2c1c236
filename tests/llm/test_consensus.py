import math
import random
from datetime import datetime

import numpy as np

from ledgermill.llm.consensus import Consensus, Reliability, digamma, log_evidence, log_gamma

EV = "evidence_id long, cell_id long, model string, value_text string, support double, reader string, value string, digits int"
OCR = "cell_id long, candidates array<string>, read_at timestamp, said string"
DC = "check_id long, cell_id long, text string, predicted string, support double, value string"
AT = datetime(2030, 1, 1)


def fit(spark, ev, ocr=(), dc=()):
    return Consensus(spark.createDataFrame(list(ev), EV), spark.createDataFrame(list(ocr), OCR), spark.createDataFrame(list(dc), DC))


def test_empty_tables(spark):
    c = fit(spark, [])
    assert c.cells().collect() == [] and c.contested().collect() == []
    assert {r.reader for r in c.readers().collect()} == {"pipeline", "digit_check"}


def test_nulls_blanks_duplicates_and_clashing_names(spark):
    ev = [
        (1, 1, "a", "12,5", 0.9, "x", "y", 0), (1, 1, "a", "12,5", 0.9, "x", "y", 0), (2, 1, "a", "99", 0.1, "x", "y", 0), (3, 1, "b", " １２ . ５ ", None, None, None, None),
        (4, 1, None, "+12.5", 0.5, None, None, None), (5, 2, "a", None, 0.9, None, None, None), (6, 2, "a", "  ", 0.9, None, None, None), (7, None, "a", "3", 0.9, None, None, None),
    ]
    ocr = [(1, ["12.5", "72.5"], AT, "z"), (2, [], None, None), (3, None, AT, None), (4, [None], AT, None), (None, ["1"], AT, None)]
    dc = [(1, 1, "12.5", "125", 0.9, "q"), (1, 1, "12.5", "125", 0.9, "q"), (2, 5, "7", "7", 0.9, "q"), (3, 1, None, None, None, None)]
    got = {r.cell_id: r for r in fit(spark, ev, ocr, dc).cells().collect()}
    assert got[1].consensus == "12.5" and got[1].consensus_votes == 5 and got[1].n_readings == 1 and got[1].agreement == 1.0
    assert got[5].consensus is None and got[5].n_readers == 0  # a digit check without any reading
    assert all(got[k].consensus is None for k in (3, 4)) and None not in got


def test_ties_go_to_the_reading_that_sorts_first(spark):
    got = fit(spark, [(1, 1, "a", "5", 0.9, None, None, None), (2, 1, "b", "3", 0.9, None, None, None)]).cells().collect()
    assert [r.consensus for r in got] == ["3"] and got[0].rival_votes == 1


def test_reliable_minority_wins(spark):
    rng = random.Random(3)
    good, bad = {f"g{i}": 0.95 for i in range(5)}, {f"b{i}": 0.35 for i in range(4)}
    rows, truth, n = [], {}, 0
    for cell in range(400):
        truth[cell] = f"{rng.randint(10, 99)}.{rng.randint(0, 9)}"
        wrong = f"{rng.randint(10, 99)}.{rng.randint(0, 9)}"
        for m, p in (good | bad).items():
            if rng.random() < 0.6:
                n += 1
                rows.append((n, cell, m, truth[cell] if rng.random() < p else wrong, 0.5, None, None, None))
    c = fit(spark, rows)
    got = {r.cell_id: r.consensus for r in c.cells().collect()}
    assert sum(got[k] == truth[k] for k in got) > 0.97 * len(got)
    by = {r.reader: r for r in c.readers().collect()}
    assert all(by[f"model:{g}"].reliability > 0.85 for g in good) and all(by[f"model:{b}"].reliability < 0.55 for b in bad)
    assert by["pipeline"].converged and by["pipeline"].rounds < 60
    weight = {r.reader: r.reliability for r in by.values()}
    assert {r.reader: (r.n_statements, r.n_agreed) for r in c.agreement().collect()}["model:g0"] == (sum(r[2] == "g0" for r in rows), sum(r[2] == "g0" and got[r[1]] == r[3] for r in rows))
    assert len(weight) == 11


def droppers(seed=11):
    """Readers that lose the point of every decimal number, beside ones that err now and then.

    Most cells have more careful readers, so the droppers' way of erring can be learned; in
    the contested ones four droppers stand against one careful reader.
    """
    rng = random.Random(seed)
    rows, truth, contested = [], {}, []
    for cell in range(900):
        whole = cell % 2 == 0
        truth[cell] = str(rng.randint(100, 999)) if whole else f"{rng.randint(10, 99)}.{rng.randint(1, 9)}"
        hard = not whole and cell % 10 == 1
        if hard:
            contested.append(cell)
        readers = [f"good{i}" for i in rng.sample(range(6), 1 if hard else 4)] + [f"drop{i}" for i in rng.sample(range(6), 4 if hard else 2)]
        for r in readers:
            said = truth[cell].replace(".", "") if r.startswith("drop") else truth[cell] if rng.random() < 0.85 else str(rng.randint(1000, 9999))
            rows.append((len(rows), cell, r, said, 0.5, None, None, None))
    return rows, truth, contested


def one_coin(rows, rounds=20):
    """Weighted vote with one accuracy per reader, iterated."""
    weight = dict.fromkeys({r[2] for r in rows}, 1.0)
    for _ in range(rounds):
        score = {}
        for _, cell, r, v, *_ in rows:
            score.setdefault(cell, {}).setdefault(v, 0.0)
            score[cell][v] += weight[r]
        best = {c: max(s, key=s.get) for c, s in score.items()}
        for r in weight:
            own = [best[x[1]] == x[3] for x in rows if x[2] == r]
            weight[r] = math.log(2 * (sum(own) + 1) / (len(own) - sum(own) + 1))
    return best


def test_confusion_matrices_win_where_one_accuracy_fails(spark):
    rows, truth, contested = droppers()
    coin = one_coin(rows)
    got = {r.cell_id: r.consensus for r in fit(spark, rows).cells().collect()}
    wrong = lambda answer: sum(answer[c] != truth[c] for c in contested)
    assert wrong(coin) > 0.8 * len(contested) and wrong(got) < 0.2 * len(contested)
    assert sum(got[c] == truth[c] for c in truth) > 0.95 * len(truth)


def test_types_decide_for_readers_with_few_labels(spark):
    rows, truth, _ = droppers()
    few = [c for c in truth if c % 2][-12:]
    for k, cell in enumerate(few[:6]):  # three new droppers and one new careful reader: their labels so far are ordinary ones
        rows += [(10_000 + 10 * k + i, cell, f"new{i}", truth[cell].replace(".", ""), 0.5, None, None, None) for i in range(3)]
        rows += [(10_009 + 10 * k, cell, "new_good", truth[cell], 0.5, None, None, None)]
    rows += [(20_000 + i, 5000, f"new{i}", "123", 0.5, None, None, None) for i in range(3)] + [(20_009, 5000, "new_good", "12.3", 0.5, None, None, None)]
    ev = spark.createDataFrame(rows, EV)
    none = spark.createDataFrame([], OCR), spark.createDataFrame([], DC)
    one, four = (Consensus(ev, *none, types=t) for t in (1, 4))
    told = {t: {r.reader: r for r in c.readers().collect()} for t, c in ((1, one), (4, four))}
    drops = [told[4][f"model:new{i}"].confusion["one_decimal>same_digits"] for i in range(3)]
    assert min(drops) > 0.7 > max(told[1][f"model:new{i}"].confusion["one_decimal>same_digits"] for i in range(3))
    assert {told[4][f"model:new{i}"].reader_type for i in range(3)} == {told[4]["model:drop0"].reader_type} != {told[4]["model:good0"].reader_type}
    got = {r.cell_id: r.consensus for r in four.cells().collect()}
    assert got[5000] == "12.3"


def outcome(said, truth):
    digits = lambda v: "".join(c for c in v if c.isdigit())
    return 0 if said == truth else 1 if digits(said) == digits(truth) else 2 if len(said) == len(truth) else 3


def kind(v):
    return 0 if "." not in v else 1 if len(v.split(".")[1]) == 1 else 2


def test_one_round_against_plain_loops(spark):
    rows, *_ = droppers(5)
    rows = rows[:400]
    c = fit(spark, rows)
    m = c.model
    names = {n: i for i, n in enumerate(c.names)}
    cells = {}
    for _, cell, r, v, *_ in rows:
        cells.setdefault(cell, []).append((names[f"model:{r}"], v))
    counts, want = np.zeros((len(names), 4, 4)), {}
    for cell, said in cells.items():
        options = sorted({v for _, v in said})
        logs = [sum(m.log_chance[r, kind(o), outcome(v, o)] for r, v in said) for o in options]
        q = np.exp(np.array(logs) - max(logs))
        q /= q.sum()
        want[cell] = options[int(np.argmax(np.round(q, 12)))], round(float(q.max()), 6)
        for o, p in zip(options, q):
            for r, v in said:
                counts[r, kind(o), outcome(v, o)] += p
    assert {r.cell_id: (r.consensus, round(r.posterior, 6)) for r in c.cells().collect()} == want
    assert np.abs(counts - m.counts).max() < 0.05  # the counts of the last round but one: the fit has settled
    # The matrices: each type's posterior mean, mixed by the reader's chance of being of that type.
    alpha = m.strength * m.type_matrix
    for r in range(len(names)):
        mixed = sum(m.member[r, t] * (m.counts[r] + alpha[t]) / (m.counts[r] + alpha[t]).sum(1, keepdims=True) for t in range(4))
        assert np.allclose(mixed, m.matrix[r])


def test_bound_grows():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.multinomial(n, p, 4)[None] for n, p in [(300, [0.9, 0.04, 0.03, 0.03])] * 4 + [(200, [0.4, 0.5, 0.05, 0.05])] * 3 + [(3, [0.9, 0.04, 0.03, 0.03])]])
    m = Reliability([f"r{i}" for i in range(8)])
    grown = [m.update(counts.astype(float)) for _ in range(6)]
    assert all(g > -1e-9 for g in grown[1:]) and abs(grown[-1]) < 1e-6


def test_few_labels_are_drawn_to_the_type():
    counts = np.zeros((5, 16))
    counts[:4, 0], counts[:4, 3] = 950, 50
    counts[4, 0] = 1
    m = Reliability([f"r{i}" for i in range(5)], types=2)
    m.update(counts)
    assert 0.9 < m.exact[4] < 0.99


def test_gamma_functions():
    assert all(abs(log_gamma(np.array([x]))[0] - math.lgamma(x)) < 1e-9 for x in (0.05, 0.5, 1.0, 7.99, 8.0, 123.4))
    # Chance of the counts (2, 1) under a flat prior over two outcomes, order known: 1/2 * 2/3 * 1/4.
    assert abs(log_evidence(np.array([[2.0, 1.0]]), np.ones((1, 2))) - math.log(1 / 12)) < 1e-9


def test_digamma():
    assert abs(digamma(np.array([1.0]))[0] + 0.5772156649) < 1e-9 and abs(digamma(np.array([10.0]))[0] - 2.2517525890667) < 1e-9
