"""Problem 6: evaluation passages that stand in documents.

Size-partitioned MinHash containment. Items are partitioned by size into pieces: an item
of at least ``run`` words gives all its pieces of ``run`` consecutive words, a shorter one
(where asked for) is one piece of its own length. Documents are slid over at the piece
length of each partition, so piece and passage have equal size and containment 1 means
equal MinHash: the MinHash of a piece is the least hash of its five-word shingles, and no
contained piece can be missed. Consecutive pieces mostly share their MinHash, so a text
gives about one value for every four words. Hits are verified by exact containment of
the piece's shingle sequence, word by word.

The items' pieces travel to the executors only when there are at most ``ITEM_PIECES`` of
them (eight bytes each). Beyond that both sides meet in joins, with the same result:
documents give their distinct MinHashes, which are kept where some item has them (a
semi-join, so a stock sentence in many items brings no pairs); at the kept places they give
the hash of the whole piece, and only equal pieces make a pair. Pairs are verified word by
word with each text fetched once, whatever the number of its items.

Cases. Null or empty texts and null ids give nothing. Words are maximal runs of letters
and digits in lower case; unseen characters are dropped and a word broken by a hyphen at
a line end is one word. Repeated rows give one result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm import textarrays as ta
from ledgermill.session import stage, tune

SHINGLE = 5
#: Pieces of items that are sent to executors as one array (8 MB of hashes); more are joined.
ITEM_PIECES = 1_000_000
HITS = "doc_id long, item_id long, longest int, matched_words int, item_words int"


def _minhash(words: ta.Words, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of each run of ``piece`` words that lies in one text, and the run's first word."""
    sh = ta.shingles(words.value, SHINGLE)
    least = ta.sliding_min(sh, piece - SHINGLE + 1)
    inside = words.owner[: len(least)] == words.owner[piece - 1 : piece - 1 + len(least)]
    at = np.flatnonzero(inside)
    return least[at], at


class _Items:
    """The items' words and, per piece length, the sorted MinHashes of their pieces."""

    def __init__(self, ids: list[int], texts: list[str], run: int, short: bool):
        self.ids = ids
        self.words = [self._values(t) for t in texts]
        by_length = defaultdict(lambda: defaultdict(list))
        for i, values in enumerate(self.words):
            piece = run if len(values) >= run else len(values) if short and len(values) >= SHINGLE else 0
            if piece:
                sh = ta.shingles(np.array(values, np.uint64), SHINGLE)
                for at, h in enumerate(ta.sliding_min(sh, piece - SHINGLE + 1).tolist()):
                    by_length[piece][h].append((i, at))
        self.pieces = {piece: dict(table) for piece, table in by_length.items()}
        self.keys = {piece: np.array(sorted(table), np.uint64) for piece, table in self.pieces.items()}

    @staticmethod
    def _values(text: str) -> list[int]:
        return ta.Words([text]).value.tolist()


def _near(keys: np.ndarray) -> np.ndarray:
    """A bit map of the keys' low 20 bits, looked at before the binary search."""
    bits = np.zeros(1 << 20, bool)
    bits[keys & np.uint64((1 << 20) - 1)] = True
    return bits


def _runs(doc: list[int], item: list[int], starts: list[tuple[int, int]], piece: int) -> list[tuple[int, int]]:
    """Maximal common runs of words (item from, length) grown from verified pieces."""
    out, reached = [], {}
    for d, i in sorted(set(starts)):
        if reached.get(d - i, -1) >= d + piece or doc[d : d + piece] != item[i : i + piece]:
            continue
        a, b = d, d + piece
        while a > 0 and i - (d - a) > 0 and doc[a - 1] == item[i - (d - a) - 1]:
            a -= 1
        while b < len(doc) and i + (b - d) < len(item) and doc[b] == item[i + (b - d)]:
            b += 1
        reached[d - i] = b
        out.append((i - (d - a), b - a))
    return out


def _scan(shared, run: int):
    def go(batches):
        items = shared.value
        near = {piece: _near(keys) for piece, keys in items.keys.items()}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for lo, hi in ta.blocks(texts):
                words = ta.Words(texts[lo:hi])
                found = defaultdict(list)
                for piece, keys in items.keys.items():
                    least, at = _minhash(words, piece)
                    maybe = np.flatnonzero(near[piece][least & np.uint64((1 << 20) - 1)])
                    place = np.searchsorted(keys, least[maybe])
                    hit = maybe[keys[np.minimum(place, len(keys) - 1)] == least[maybe]]
                    for h, w in zip(least[hit].tolist(), at[hit].tolist()):
                        for item, i in items.pieces[piece][h]:
                            found[int(words.owner[w]), item, piece].append((w, i))
                first = np.searchsorted(words.owner, np.arange(hi - lo + 1))
                for (owner, item, piece), starts in found.items():
                    base = int(first[owner])
                    doc = words.value[base : first[owner + 1]].tolist()
                    spans = _runs(doc, items.words[item], [(w - base, i) for w, i in starts], piece)
                    if spans:
                        covered = set().union(*(range(i, i + n) for i, n in spans))
                        rows.append((ids[lo + owner], items.ids[item], max(n for _, n in spans), len(covered), len(items.words[item])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "longest", "matched_words", "item_words"])

    return go


def _pieces(words: ta.Words, lengths: list[int]):
    """MinHash, whole hash and first word of every piece of one text, for each piece length."""
    for n in lengths:
        least, at = _minhash(words, n)
        yield n, least, ta.shingles(words.value, n)[at] if len(at) else np.empty(0, np.uint64), at


def _doc_prints(lengths: list[int]):
    """Arrow kernel: the distinct MinHashes of a text's pieces."""

    def go(batches):
        for batch in batches:
            out = [np.unique(np.concatenate([least for _, least, _, _ in _pieces(ta.Words([t]), lengths)])).view(np.int64).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return go


def _item_prints(run: int, short: bool):
    """Arrow kernel: MinHash and whole hash of every piece of an item; its piece length depends on its size."""

    def go(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ta.Words([t])
                n = len(words.value)
                piece = run if n >= run else n if short and n >= SHINGLE else 0
                for _, least, whole, _ in _pieces(words, [piece] if piece else []):
                    rows += [(i, h, e) for h, e in zip(least.view(np.int64).tolist(), whole.view(np.int64).tolist())]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "h", "e"])

    return go


def _doc_pieces(lengths: list[int]):
    """Arrow kernel: whole hashes of the pieces whose MinHash some item has."""

    def go(batches):
        for batch in batches:
            ids, out = [], []
            for i, t, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                wanted = np.array(hits, np.int64).view(np.uint64)
                for _, least, whole, _ in _pieces(ta.Words([t]), lengths):
                    found = np.unique(whole[np.isin(least, wanted)]).view(np.int64).tolist()
                    ids += [i] * len(found)
                    out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], ["doc_id", "e"])

    return go


def _verify(run: int, short: bool):
    def go(batches):
        for batch in batches:
            rows = []
            for doc_id, text, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                items = _Items([x["item_id"] for x in held], [x["item_text"] for x in held], run, short)
                doc = ta.Words([text])
                values = doc.value.tolist()
                starts = defaultdict(list)
                for piece, table in items.pieces.items():
                    least, at = _minhash(doc, piece)
                    hit = np.flatnonzero(np.isin(least, items.keys[piece]))
                    for h, w in zip(least[hit].tolist(), at[hit].tolist()):
                        for item, i in table[h]:
                            starts[item, piece].append((w, i))
                for (item, piece), found in starts.items():
                    spans = _runs(values, items.words[item], found, piece)
                    if spans:
                        covered = set().union(*(range(i, i + n) for i, n in spans))
                        rows.append((doc_id, items.ids[item], max(n for _, n in spans), len(covered), len(items.words[item])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "longest", "matched_words", "item_words"])

    return go


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, short: bool = False, item_pieces: int = ITEM_PIECES) -> DataFrame:
    """One row per document and item: longest common run, item words found, item words.

    ``short`` also looks for items of 5 to ``run - 1`` words, which must stand whole.
    """
    if run < SHINGLE:
        raise ValueError(f"run must be at least {SHINGLE} words")
    spark = tune(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    held = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    size = held.agg(F.sum(F.length("item_text")).alias("n")).first()["n"] or 0
    if size <= 2 * item_pieces:  # a word takes two characters at least, and starts one piece
        rows = held.orderBy("item_id", "item_text").collect()
        shared = spark.sparkContext.broadcast(_Items([r["item_id"] for r in rows], [r["item_text"] for r in rows], run, short))
        found = docs.mapInArrow(_scan(shared, run), HITS)
    else:
        lengths = list(range(SHINGLE, run + 1)) if short else [run]
        prints = stage(held.mapInArrow(_item_prints(run, short), "item_id long, h long, e long").distinct(), "leak-items")
        seen = docs.mapInArrow(_doc_prints(lengths), "doc_id long, hashes array<long>").select("doc_id", F.explode("hashes").alias("h")).distinct()
        hits = seen.join(prints.select("h").distinct(), "h", "left_semi").groupBy("doc_id").agg(F.collect_list("h").alias("hits"))  # at most a text's own pieces
        pieces = docs.join(hits, "doc_id").select("doc_id", "text", "hits").mapInArrow(_doc_pieces(lengths), "doc_id long, e long").distinct()
        near = stage(pieces.join(prints.select("item_id", "e"), "e").select("doc_id", "item_id").distinct(), "leak-pairs")
        of_doc = near.join(held, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))  # its own leaks
        found = docs.join(of_doc, "doc_id").select("doc_id", "text", "items").mapInArrow(_verify(run, short), HITS)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item its leaks: documents, how many hold the whole item, longest run and greatest containment."""
    per = found.groupBy("item_id").agg(
        F.count("*").alias("n_docs"),
        F.sum((F.col("longest") == F.col("item_words")).cast("long")).alias("n_whole"),
        F.max("longest").alias("longest_run"),
        F.round(F.max(F.col("matched_words") / F.greatest(F.col("item_words"), F.lit(1))), 6).alias("containment"),
    )
    base = items.select(F.col("item_id").cast("long").alias("item_id"), "suite", "split_role").where("item_id is not null").dropDuplicates(["item_id"])
    return base.join(per, "item_id", "left").na.fill({"n_docs": 0, "n_whole": 0, "longest_run": 0, "containment": 0.0})
