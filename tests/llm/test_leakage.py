import random
import re

from ledgermill.llm import leakage

DOCS = "doc_id long, text string, h long, item_id long, hashes string"
ITEMS = "item_id long, item_text string, suite string, split_role string, text string"


def words(t):
    t = re.sub("[­​﻿⁠]", "", t or "")
    return re.findall(r"[^\W_]+", re.sub(r"(?<=[^\W_])[-‐][^\S\n]*\r?\n\s*(?=[^\W_])", "", t).lower())


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "s", "test", "y") for i, t in items], ITEMS)


def brute(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = words(t)
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, x in items:
            v = words(x)
            if d is not None and i is not None and any(tuple(v[k : k + n]) in runs for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_both_paths_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["Über", "лист", "row", "97", "año", "seal", "ink", "tray"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40)))) for i in range(12)]
    docs = [(None, items[0][1]), (900, None), (901, ""), (902, "x" * 5000)]
    for d in range(60):
        body = [rng.choice(vocab) + str(rng.randint(0, 5)) for _ in range(rng.randint(0, 80))]
        v = items[rng.randrange(12)][1].split()
        a = rng.randrange(len(v))
        body[3:3] = v[a : a + rng.randint(5, 20)]
        text = " ".join(body).replace("row ", "r­ow ", 1).replace("seal ", "se-\n  al ", 1)
        docs.append((d, text))
    docs += [docs[5]]
    items += [(None, "a b c"), (50, None), (51, ""), items[1]]
    want = brute(docs, items)
    assert want
    D, I = frames(spark, docs, items)
    for bound in (leakage.ITEM_PIECES, 0):
        found = leakage.leaks(D, I, item_pieces=bound)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
        assert all(r.longest >= 12 for r in found.collect())
    assert leakage.report(leakage.leaks(D, I, short=True), I).count() == len({i for i, _ in items if i is not None})


def test_short_items_must_stand_whole(spark):
    D, I = frames(spark, [(1, "a b c d e f g"), (2, "a b c d x")], [(7, "B c d E f"), (8, "a b")])
    for bound in (leakage.ITEM_PIECES, 0):
        assert {(r.doc_id, r.item_id) for r in leakage.leaks(D, I, short=True, item_pieces=bound).collect()} == {(1, 7)}


def test_empty(spark):
    D, I = frames(spark, [], [])
    assert leakage.leaks(D, I).collect() == [] and leakage.leaks(D, I, item_pieces=-1).collect() == []
