"""Problem 8: long stretches that stand letter for letter in more than one document.

Seed and extend. Every document gives winnowed anchors: of each ``min_len - seed + 1``
consecutive runs of ``seed`` characters the one of least hash. Two documents that share
``min_len`` characters share an anchor inside that stretch. Documents are joined on
anchors, and each match is extended both ways. An anchor lies at most ``min_len - seed``
characters from the next one, so it is enough to extend by that much on each side: the
union of the extended pieces on one diagonal is the maximal repeat.

Skew. Exact copies are one class from the start (anchors are keyed by a 128-bit digest of
the text), so a text copied a million times gives its anchors once. An anchor that stands
in more than ``crowd`` classes is not paired: its classes are told apart by longer anchors,
winnowed anew from the stretches around it, whose window is half as wide each time (150,
225 and 263 characters for stretches of 300), so each crowded anchor gives a handful of
longer ones. What is still crowded then really shares nearly whole stretches; only there
every stretch of ``min_len`` characters around the anchor is hashed, and classes meet where
such a stretch is the same. Pairs that come from this have their letters compared, one
stretch for each set of classes. No link is lost by this and no pairs are made that do not
hold. (Coverage takes equal 64-bit hashes of these whole stretches as equal.)

Cases. Null or short texts (under ``min_len``) share nothing; null ids are left out; rows
repeated with one id are one document; other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm import textarrays as ta
from ledgermill.session import release, stage, tune

ANCHORS = "doc_id long, digest binary, n_chars int, anchors array<struct<h: long, pos: int>>"
PIECES = "size int, h long, digest binary, pos int, lead int, context string, doc_id long"
MATCHES = "digest_a binary, start_a int, digest_b binary, start_b int, span int"
#: Classes that may share an anchor and still be paired directly.
CROWD = 32


def _picked(codes: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the winnowed anchors of one text."""
    grams = ta.gram_hashes(codes, seed)
    least = ta.sliding_min(grams, window)
    # A value is an anchor where it is the least of some window that covers it.
    reach = np.concatenate((np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)))
    top = ~ta.sliding_min(~reach, window)
    at = np.flatnonzero(grams == top)
    return grams[at].view(np.int64), at


def _anchor_rows(seed: int, min_len: int):
    window = min_len - seed + 1
    step = ta.BLOCK

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            hashes, places, counts, digests, sizes = [], [], [], [], []
            for text in texts:
                codes = ta.points(text)
                digests.append(xxhash.xxh3_128_digest(codes.tobytes()))
                sizes.append(len(codes))
                found = 0
                for off in range(0, max(1, len(codes) - min_len + 1), step):  # slices overlap by one stretch less a character
                    h, at = _picked(codes[off : off + step + min_len - 1], seed, window)
                    hashes.append(h)
                    places.append((at + off).astype(np.int32))
                    found += len(h)
                counts.append(found)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(hashes or [np.empty(0, np.int64)])), pa.array(np.concatenate(places or [np.empty(0, np.int32)]))], ["h", "pos"]
            )
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "digest", "n_chars", "anchors"],
            )

    return run


def anchors(documents: DataFrame, min_len: int = 300, seed: int = 150) -> DataFrame:
    """One staged row per document of at least ``min_len`` characters with its digest and anchors."""
    tune(documents.sparkSession)
    long_enough = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & (F.length("text") >= min_len)
    )
    return stage(long_enough.mapInArrow(_anchor_rows(seed, min_len), ANCHORS), "span-anchors")


def levels(seed: int, min_len: int) -> list[int]:
    """Anchor lengths: the seed, then longer ones with half the window each, then the whole stretch."""
    out = [seed]
    while min_len - out[-1] > 40:
        out.append(out[-1] + (min_len - out[-1] + 1) // 2)
    return out if out[-1] == min_len else [*out, min_len]


def _near(places: np.ndarray, size: int, crowded: np.ndarray, before: int, min_len: int) -> np.ndarray:
    """Which anchors of ``size`` at sorted ``places`` lie in one stretch with a crowded anchor of ``before`` characters."""
    first = np.searchsorted(crowded, places + size - min_len)
    return first < np.searchsorted(crowded, places + min_len - before, side="right")


def _piece_rows(size: int, longer: int, min_len: int):
    """Arrow kernel: contexts of a level's anchors, and the next level's anchors (context null) around crowded ones."""
    side = min_len - size

    def run(batches):
        for batch in batches:
            ids, digests, texts, wanted = (batch.column(i).to_pylist() for i in range(4))
            out = {k: [] for k in ("size", "h", "digest", "pos", "lead", "context", "doc_id")}
            for doc_id, digest, text, places in zip(ids, digests, texts, wanted):
                codes = ta.points(text)
                if xxhash.xxh3_128_digest(codes.tobytes()) != digest:  # another text under the same id
                    continue
                rows = [(size, x["h"], digest, x["pos"], x["pos"] - max(0, x["pos"] - side), text[max(0, x["pos"] - side) : x["pos"] + size + side], doc_id) for x in places if not x["crowded"]]
                crowded = np.array(sorted(x["pos"] for x in places if x["crowded"]), np.int64)
                if len(crowded):
                    for lo, hi in _regions(crowded, size, min_len, len(codes)):
                        h, at = _picked(codes[lo:hi], longer, min_len - longer + 1)
                        near = _near(at + lo, longer, crowded, size, min_len)
                        rows += [(longer, h_, digest, p, 0, None, doc_id) for h_, p in zip(h[near].tolist(), (at[near] + lo).tolist())]
                for row in rows:
                    for key, value in zip(out, row):
                        out[key].append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out))

    return run


def _regions(crowded: np.ndarray, size: int, min_len: int, n: int) -> list[tuple[int, int]]:
    """The parts of a text that stretches with a crowded anchor lie in, joined where they overlap.

    A part takes another stretch on each side, so its anchors are those of the whole text.
    """
    out: list[list[int]] = []
    for p in crowded.tolist():
        lo, hi = max(0, p + size - 2 * min_len), min(n, p + 2 * min_len)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out if hi - lo >= min_len]


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _extend_rows(min_len: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for size, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group.sort(key=lambda g: (g["digest"], g["pos"]))
                for i, a in enumerate(group):
                    for b in group[i + 1 :]:
                        la, lb, ca, cb = a["lead"], b["lead"], a["context"], b["context"]
                        if a["digest"] == b["digest"] or ca[la : la + size] != cb[lb : lb + size]:
                            continue
                        left = _common(ca[:la][::-1], cb[:lb][::-1])
                        right = _common(ca[la + size :], cb[lb + size :])
                        if left + size + right >= min_len:
                            for column, value in zip(out, (a["digest"], a["pos"] - left, b["digest"], b["pos"] - left, left + size + right)):
                                column.append(value)
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["digest_a", "start_a", "digest_b", "start_b", "span"])

    return run


class SharedSpans:
    """The parts of the answer; each is built once and shared by the reports."""

    def __init__(self, documents: DataFrame, min_len: int = 300, seed: int = 150, crowd: int = CROWD):
        if not 0 < seed <= min_len:
            raise ValueError("seed must lie between 1 and min_len")
        self.documents, self.min_len, self.crowd = documents, min_len, crowd
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= min_len))
        self.staged = anchors(documents, min_len, seed)
        #: doc_id, digest, n_chars: which class of exact copies a document is in.
        self.members = self.staged.select("doc_id", "digest", "n_chars").distinct()
        #: Contexts of anchors to pair, one table per level, and whole stretches of crowded anchors (None without any).
        self.pieces: list[DataFrame] = []
        self.whole: DataFrame | None = None
        self._build(levels(seed, min_len))

    def _build(self, sizes: list[int]) -> None:
        rows = self.staged.select("doc_id", "digest", F.inline("anchors"))
        key = F.xxhash64("digest")  # fixed-width buffers keep this a hash aggregate
        for k, size in enumerate(sizes):
            seen = stage(rows.groupBy("h", "digest", "pos").agg(F.min("doc_id").alias("doc_id")), "span-seen")
            shared = seen.groupBy("h").agg(F.count("*").alias("n"), F.min(key).alias("d0"), F.max(key).alias("d1")).where("d0 <> d1").select("h", "n")
            if k and size == self.min_len:  # whole stretches: nothing to extend
                self.whole = stage(seen.join(shared.select("h"), "h"), "span-whole")
                release(seen)
                return
            last = size == self.min_len
            crowded = F.lit(False) if last else F.col("n") > self.crowd
            places = seen.join(shared, "h").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("h", "pos", crowded.alias("crowded"))).alias("places"))
            longer = size if last else sizes[k + 1]
            found = stage(self.texts.join(places, "doc_id").select("doc_id", "digest", "text", "places").mapInArrow(_piece_rows(size, longer, self.min_len), PIECES), "span-pieces")
            release(seen)
            self.pieces.append(found.where("context is not null"))
            rows = found.where("context is null").select("h", "digest", "pos", "doc_id")
            if not rows.limit(1).count():
                return

    def matches(self) -> DataFrame:
        """Verified pieces between two classes: where they begin and how long they are."""
        out = None
        for pieces in self.pieces:
            groups = pieces.dropDuplicates(["h", "digest", "pos"]).groupBy("size", "h").agg(F.collect_list(F.struct("digest", "pos", "lead", "context")).alias("g"))
            rows = groups.select("size", "g").mapInArrow(_extend_rows(self.min_len), MATCHES)
            out = rows if out is None else out.union(rows)
        return out

    def class_pairs(self) -> DataFrame:
        """Pairs of classes that share a stretch, each once.

        Crowded stretches next to each other mostly have the same classes; of all stretches
        with equal class sets (compared by size and two sums of hashes) one is paired, letter
        by letter. The pairs made are pairs of the result.
        """
        pairs = self.matches().select("digest_a", "digest_b")
        if self.whole is not None:
            members = self.whole.groupBy("h", "digest").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
            sets = members.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("s"))
            one = sets.groupBy("n", "x", "s").agg(F.min("h").alias("h")).select("h")
            chosen = members.join(one, "h").select("h", "digest", "at.doc_id", "at.pos")
            spelled = chosen.join(self.texts, "doc_id").select("h", "digest", F.substring("text", F.col("pos") + 1, F.lit(self.min_len)).alias("letters")).groupBy("h", "letters", "digest").agg(F.lit(1).alias("one"))
            met = spelled.alias("a").join(spelled.alias("b"), F.expr("a.h = b.h and a.letters = b.letters and a.digest < b.digest")).select(F.col("a.digest").alias("digest_a"), F.col("b.digest").alias("digest_b"))
            pairs = pairs.union(met)
        return pairs.distinct()

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), smaller first, of all documents that share a stretch."""
        m = self.members.select("doc_id", "digest")
        left, right = m.toDF("ida", "digest_a"), m.toDF("idb", "digest_b")
        across = self.class_pairs().join(left, "digest_a").join(right, "digest_b").select("ida", "idb")
        copies = m.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        some = m.join(copies, "digest")
        within = some.alias("a").join(some.alias("b"), F.expr("a.digest = b.digest and a.doc_id < b.doc_id")).select(F.col("a.doc_id").alias("ida"), F.col("b.doc_id").alias("idb"))
        return across.union(within).select(F.least("ida", "idb").alias("doc_id_a"), F.greatest("ida", "idb").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()

    def covered(self) -> DataFrame:
        """Per class the maximal stretches (begin, end) that stand in another class too."""
        m = self.matches()
        parts = m.select(F.col("digest_a").alias("digest"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("span")).alias("e")).union(m.select("digest_b", "start_b", F.col("start_b") + F.col("span")))
        if self.whole is not None:
            parts = parts.union(self.whole.select("digest", "pos", F.col("pos") + self.min_len))
        parts = parts.groupBy("digest", "s").agg(F.max("e").alias("e"))
        order = Window.partitionBy("digest").orderBy("s", "e")
        reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(F.col("s") <= reach, 0).otherwise(1)
        return (
            parts.withColumn("new", new)
            .withColumn("island", F.sum("new").over(order))
            .groupBy("digest", "island")
            .agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"))
            .select("digest", "span_start", "span_end")
        )

    def coverage(self) -> DataFrame:
        """One row per document: class (least doc_id of its exact copies), copies, shared characters and share.

        A document with an exact copy is shared as a whole; texts under ``min_len`` have 0 spans.
        """
        per = self.covered().groupBy("digest").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("chars"), F.max(F.col("span_end") - F.col("span_start")).alias("longest"))
        classes = self.members.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
        base = self.documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_text")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n_text").alias("n_text"))
        rows = base.join(self.members.select("doc_id", "digest").join(classes, "digest").join(per, "digest", "left"), "doc_id", "left")
        whole = F.coalesce(F.col("n_copies"), F.lit(1)) > 1
        return rows.select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
            F.col("n_text").alias("n_chars"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.col("n_text")).otherwise(F.coalesce("chars", F.lit(0))).cast("long").alias("shared_chars"),
            F.when(whole, F.col("n_text")).otherwise(F.coalesce("longest", F.lit(0))).cast("long").alias("longest_span"),
            F.round(F.when(whole, F.lit(1.0)).otherwise(F.coalesce("chars", F.lit(0)) / F.greatest("n_text", F.lit(1))), 6).alias("shared_share"),
        )
