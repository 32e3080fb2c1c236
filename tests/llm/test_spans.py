import itertools
import random

import numpy as np
import pytest

from ledgermill.llm import textarrays as ta
from ledgermill.llm.spans import SharedSpans, _picked, levels

DOCS = "doc_id long, text string, digest string, h long, n int, whole long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOCS)


def brute(docs, n):
    where = {}
    for i, t in {(i, t) for i, t in docs if i is not None and t}:
        for k in range(len(t) - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    pairs = {p for s in where.values() for p in itertools.combinations(sorted(s), 2)}
    covered = {i: set() for i, _ in docs if i is not None}
    for i, t in {(i, t) for i, t in docs if i is not None and t}:
        for k in range(len(t) - n + 1):
            if len(where[t[k : k + n]]) > 1:
                covered[i].update(range(k, k + n))
    return pairs, {i: len(c) for i, c in covered.items()}


def corpus(seed, scale=1):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé 漢😀\n") for _ in range(n * scale))
    shared = [text(rng.randint(30, 120)) for _ in range(6)]
    stock = text(35)  # long enough for an anchor, too short to count
    docs = [(None, shared[0]), (500, None), (501, ""), (502, "short")]
    for i in range(60):
        docs.append((i, text(rng.randint(0, 80)) + stock + text(rng.randint(0, 20)) + rng.choice(shared)[rng.randint(0, 20 * scale) :] + text(rng.randint(0, 60))))
    docs += [(100 + i, docs[10][1]) for i in range(5)] + [docs[12]]
    return docs


@pytest.mark.parametrize("crowd", [3, 1000])
def test_pairs_and_coverage_against_brute_force(spark, crowd):
    docs = corpus(crowd)
    pairs, covered = brute(docs, 40)
    s = SharedSpans(frame(spark, docs), min_len=40, seed=20, crowd=crowd)
    assert pairs and {tuple(r) for r in s.pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == covered


@pytest.mark.parametrize("crowd", [2, 8])
def test_longer_anchors_tell_crowds_apart(spark, crowd):
    docs = corpus(crowd, 3)
    pairs, covered = brute(docs, 120)
    s = SharedSpans(frame(spark, docs), min_len=120, seed=60, crowd=crowd)
    assert len(s.pieces) == 2 and len(pairs) > 20
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == covered


def test_stock_passages_give_few_longer_anchors(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    stock = text(230)
    docs = [(i, text(400) + stock + text(400)) for i in range(120)] + [(200 + i, text(50) + docs_part) for i, docs_part in enumerate([stock + "tail" * 30] * 2)]
    s = SharedSpans(frame(spark, docs))
    assert levels(150, 300) == [150, 225, 263, 300] and s.whole is None
    assert {tuple(r) for r in s.pairs().collect()} == {(200, 201)}
    assert sum(p.count() for p in s.pieces) < 5 * len(docs)


def test_repeated_characters(spark):
    docs = [(1, "a" * 200), (2, "b" + "a" * 90 + "c"), (3, "a" * 39), (4, "z" * 200)]
    s = SharedSpans(frame(spark, docs), min_len=40, seed=20, crowd=5)
    assert {tuple(r) for r in s.pairs().collect()} == {(1, 2)}
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == {1: 200, 2: 90, 3: 0, 4: 0}


def test_empty(spark):
    s = SharedSpans(frame(spark, []))
    assert s.pairs().collect() == [] and s.coverage().collect() == []
    with pytest.raises(ValueError):
        SharedSpans(frame(spark, []), min_len=10, seed=20)


def test_winnowing_guarantee_and_slices():
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 100, 4000).astype(np.uint32)
    _, at = _picked(codes, 20, 21)
    chosen = set(at.tolist())
    assert all(any(k in chosen for k in range(w, w + 21)) for w in range(len(codes) - 40 + 1))


def test_long_text_in_slices(spark, monkeypatch):
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh") for _ in range(3_000_000))
    docs = [(1, body), (2, "x" * 50 + body[1_048_300:1_049_000] + "y" * 50)]
    s = SharedSpans(frame(spark, docs))
    assert {tuple(r) for r in s.pairs().collect()} == {(1, 2)}
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == {1: 700, 2: 700}


def test_gram_hashes_and_sliding_min():
    codes = np.array([5, 6, 7, 5, 6, 7, 5], np.uint32)
    for k in (1, 2, 3, 5, 7):
        h = ta.gram_hashes(codes, k)
        assert len(h) == 8 - k and (k > 4 or h[0] == h[3])
    a = np.array([3, 1, 2, 5, 4], np.uint64)
    for w in range(1, 6):
        assert ta.sliding_min(a, w).tolist() == [min(a[i : i + w]) for i in range(6 - w)]
