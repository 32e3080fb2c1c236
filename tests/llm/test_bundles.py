import random
from datetime import datetime

from ledgermill.llm.bundles import Bundles, components

PROV = "record_id long, document_id string, source_group string, source_split string, loaded_at timestamp, bundle_key long, doc string, u long"
ROLES = [("train", "train"), ("val", "validation"), ("test", "test"), ("gone", "none")]


def bundles(spark, rows):
    rows = [(*r, datetime(2030, 1, 1), 1, "x", 2) for r in rows]
    return Bundles(spark.createDataFrame(rows, PROV), spark.createDataFrame(ROLES, "source_split string, split_role string"))


def truth(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, d, g, _ in rows:
        for kind, key in (("d", d), ("g", g)):
            key = (key or "").strip(" ").lower()
            if key not in ("", "unknown", "n/a", "-", "none"):
                parent[find(("r", r))] = find((kind, key))
        find(("r", r))
    groups = {}
    for r, *_ in rows:
        groups.setdefault(find(("r", r)), []).append(r)
    return {r: min(g) for g in groups.values() for r in g}


def test_random_graph_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = []
    for r in range(1, 601):
        d = rng.choice([None, " ", f"Doc{rng.randint(1, 250)}", f" doc{rng.randint(1, 250)} "])
        g = "hot" if r % 3 == 0 else rng.choice([None, "unknown", "-", " N/A", f"G{rng.randint(1, 200)}"])
        rows.append((r, d, g, rng.choice(["train", " VAL", "test", None, "gone"])))
    want = truth(rows)
    b = bundles(spark, [*rows, rows[0], (None, "Doc1", "hot", "train")])
    assert {r.record_id: r.bundle_key for r in b.records.collect()} == want
    role = {"train": "train", "val": "validation", "test": "test"}
    held = {}
    for r, _, _, s in rows:
        if (name := role.get((s or "").strip().lower())) is not None:
            held.setdefault(want[r], set()).add(name)
    assert {tuple(x) for x in b.found().collect()} == {(k, s) for k, v in held.items() if len(v) > 1 for s in v}
    assigned = b.assign().collect()
    assert len(assigned) == len(rows) and len({(r.bundle_key, r.split) for r in assigned}) == len(set(want.values()))


def test_chain_and_forest(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (3, 4), (4, 3)], "u long, v long")
    nodes, forest = components(edges)
    assert len({r.root for r in nodes.collect()}) == 1 and nodes.count() == n + 1 and forest.count() == n


def test_proportions(spark):
    rows = [(r, f"d{r // 3}", None, "train") for r in range(1, 6001)]
    got = {r.split: r.actual_share for r in bundles(spark, rows).report().collect()}
    assert abs(got["train"] - 0.8) < 0.02 and abs(got["validation"] - 0.1) < 0.02 and abs(got["test"] - 0.1) < 0.02


def test_a_giant_goes_where_it_fits(spark):
    rows = [(r, "big" if r <= 400 else f"d{r}", None, "train") for r in range(1, 1001)]
    b = bundles(spark, rows)
    got = {r.split: r.n_records for r in b.report().collect()}
    assert {r.split for r in b.assign().where("bundle_key = 1").collect()} == {"train"} and abs(got["train"] - 800) < 40


def test_empty(spark):
    b = bundles(spark, [])
    assert b.found().collect() == [] and b.assign().collect() == [] and len(b.report().collect()) == 3


def test_splits_without_a_share(spark):
    import pytest

    rows = [(i, f"d{i % 20}", None, "train") for i in range(100)]
    b = bundles(spark, rows)
    assert {r.split for r in b.assign([("train", 0.5), ("none", 0.0), ("test", 0.5)]).collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        b.deal([("train", 0.0)])
