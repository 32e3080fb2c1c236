"""Problem 4: records of evaluation splits that also stand, exactly or nearly, in training.

The gram hashes of evaluation texts are partitioned by hash, training texts are scanned
for hits, and the containment of each evaluation text per training text decides which
pairs are verified. Texts are compared as classes of equal normalised text, so a text
repeated a million times is scanned once.

Grams come in two units. *Words* (``contained``): runs of five words; an evaluation text
is reported with the training texts that hold at least 0.8 of its grams. Only the rarest
grams that such a training text cannot miss are looked up. *Characters* (``near``): the
task's measure is an edit distance of a tenth, which can touch every word, so word grams
could miss pairs. Evaluation texts give every run of ``GRAM`` characters; of a training
text ``t + HITS`` disjoint runs are looked up, where ``t`` is the most edits any partner
may have. Each edit spoils one run at most, so a partner contains at least ``HITS`` of
them, each within ``t`` places of where it was, and no pair can be missed. Which disjoint
runs are taken is free: a dynamic program takes the set that is least frequent in the
evaluation texts, by a count table of fixed size (texts are cut into stretches of
``STRETCH`` characters that each give their share, so long texts cost in proportion).
Every gram carries 16 character counts of its text, so a hit also has to fit in what the
texts are made of. Pairs with fewer hits are dropped before any text is fetched; the rest
must contain enough of each other's character pairs, and then pass the exact edit distance. Every link
carries its edits and the share of the evaluation text's word grams that the training text
contains.

Cases. A record loaded again counts once (latest load); null ids are left out; null or
blank hashes and texts under 40 characters link nothing; roles are looked up by trimmed
lower-case split, null and unknown splits have the role none. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm import textarrays as ta
from ledgermill.session import release, stage, tune

MIN_CHARS, TENTHS, GRAM, HITS, STRETCH, WORDS, CONTAINED = 40, 10, 5, 3, 900, 5, 0.8
#: Slots of the table that counts evaluation grams, one byte each (4 MB at any input size), and slots per row of it.
SLOTS, ROW = 1 << 22, 1 << 12
#: Cells of one dynamic program (a byte each).
CELLS = 1 << 23
EVALUATION = ("validation", "test")


def latest(provenance: DataFrame, *columns: str) -> DataFrame:
    """One row per record id: the last load (ties: the row that sorts last)."""
    top = F.max(F.struct("loaded_at", *columns)).alias("top")
    return provenance.where("record_id is not null").groupBy(F.col("record_id").cast("long").alias("record_id")).agg(top).select("record_id", *(F.col(f"top.{c}").alias(c) for c in columns))


def with_role(records: DataFrame, split_roles: DataFrame) -> DataFrame:
    """Adds ``role`` from the trimmed lower-case split; none where null or unknown."""
    key = F.lower(F.trim(F.col("source_split")))
    roles = split_roles.select(key.alias("role_key"), F.lower(F.trim(F.col("split_role"))).alias("role")).where("role_key is not null").dropDuplicates(["role_key"])
    return records.withColumn("role_key", key).join(roles, "role_key", "left").drop("role_key").na.fill("none", ["role"])


def plain_hash(column: Column) -> Column:
    """Trimmed, lower case, without the prefix; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(column)), r"^sha256:\s*", "")), F.lit(""))


_OTHER = re.compile(r"[\W_]+")


def plain_text(text: str | None) -> str:
    """Lower case, no accents, everything but letters and digits as a blank, blanks collapsed."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))
    return _OTHER.sub(" ", text).strip()


def _normalise(batches):
    for batch in batches:
        texts = [plain_text(t) for t in batch.column(4).to_pylist()]
        digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) if t else None for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.binary()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32())], ["record_id", "role", "dataset", "crop", "digest", "plain", "n"])


@lru_cache(100_000)
def most_edits(n: int, tenths: int = TENTHS) -> int:
    """The most edits between a text of n characters and any partner: a tenth of the longer one."""
    m = n
    while (m + 1) - (m + 1) // tenths <= n:
        m += 1
    return m // tenths


def rarest_runs(costs: list[np.ndarray], counts: list[int], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text ``counts[i]`` disjoint runs of ``gram`` characters with the least total cost: (text, place)."""
    texts, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    order = np.argsort([len(c) for c in costs], kind="stable")
    lo = 0
    while lo < len(order):
        hi, most = lo, 0
        while hi < len(order) and (hi == lo or len(costs[order[hi]]) * (max(most, counts[order[hi]]) + 1) * (hi - lo + 1) <= CELLS):
            most = max(most, counts[order[hi]])
            hi += 1
        group = order[lo:hi]
        lo = hi
        n, k, size = len(costs[group[-1]]), most, len(group)
        cost = np.full((n, size), np.inf, np.float32)
        for g, i in enumerate(group):
            cost[: len(costs[i]), g] = costs[i]
        held = np.full((gram + 1, size, k + 1), np.inf, np.float32)  # least cost from place p on, for each number of runs
        held[:, :, 0] = 0
        take = np.zeros((n, size, k + 1), bool)
        for p in range(n - 1, -1, -1):
            with_run = cost[p][:, None] + held[(p + gram) % (gram + 1), :, :-1]
            without = held[(p + 1) % (gram + 1), :, 1:]
            take[p, :, 1:] = (with_run <= without) & np.isfinite(with_run)
            held[p % (gram + 1), :, 1:] = np.minimum(with_run, without)
        at, left, mine = np.zeros(size, np.int64), np.array([counts[i] for i in group]), np.arange(size)
        for p in range(n):
            here = (at == p) & (left > 0)
            hit = here & take[p, mine, left]
            texts.append(group[hit])
            places.append(np.full(int(hit.sum()), p))
            left = left - hit
            at = np.where(hit, p + gram, np.where(here, p + 1, at))
    return np.concatenate(texts), np.concatenate(places)


def probes(grams: list[np.ndarray], lengths: list[int], cost) -> tuple[np.ndarray, np.ndarray]:
    """The runs to look up: (text, place); every stretch of a text gives its share of them."""
    costs, counts, owner, start = [], [], [], []
    for i, (g, n) in enumerate(zip(grams, lengths)):
        many, parts = most_edits(n) + HITS, -(-n // STRETCH)
        for j in range(parts):
            lo, hi = n * j // parts, n * (j + 1) // parts
            costs.append(cost(g[lo : hi - GRAM + 1]))
            counts.append(many * (j + 1) // parts - many * j // parts)
            owner.append(i)
            start.append(lo)
    part, place = rarest_runs(costs, counts, GRAM)
    return np.array(owner, np.int64)[part], place + np.array(start, np.int64)[part]


def _signatures(texts: list[str]) -> np.ndarray:
    """Of each text the counts of 16 groups of characters, as that many ones in 16 bits each (16: or more): four integers."""
    codes = ta.points("".join(texts)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    held = np.minimum(16, np.bincount(row * 16 + (codes * 7 + (codes >> 3)) % 16, minlength=16 * len(texts)))
    return ((1 << held) - 1).astype(np.uint16).reshape(-1, 4, 4).view(np.int64).reshape(-1, 4).T


def apart(a: str, b: str, most: Column) -> Column:
    """Whether texts with these signatures may be within so many edits: characters of one that the other lacks are edits."""
    more = lambda x, y: sum(F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}")))) for k in range(4))
    return (more(a, b) <= most) & (more(b, a) <= most)


def _eval_grams(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        grams = [ta.gram_hashes(ta.points(t), GRAM).view(np.int64) for t in texts]
        sizes = [len(g) for g in grams]
        which = np.repeat(np.arange(len(texts)), sizes)
        marks = _signatures(texts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(grams or [np.empty(0, np.int64)])),
                batch.column(0).take(pa.array(which)),
                pa.array(np.concatenate([np.arange(s) for s in sizes] or [np.empty(0, int)]).astype(np.int32)),
                pa.array(np.array([len(t) for t in texts], np.int32)[which] if len(texts) else np.empty(0, np.int32)),
                *(pa.array(m[which]) for m in marks),
            ],
            ["g", "eval", "eval_pos", "eval_n", "eval_m0", "eval_m1", "eval_m2", "eval_m3"],
        )


def _count_row(key, table):
    """One row of the count table: a byte per slot, eight steps for each doubling."""
    held = np.zeros(ROW, np.uint8)
    held[table["low"].to_numpy()] = np.minimum(255, np.rint(8 * np.log2(1.0 + table["n"].to_numpy()))).astype(np.uint8)
    return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([held.tobytes()], pa.binary())})


def _train_grams(counts):
    def run(batches):
        table, value = np.frombuffer(counts.value, np.uint8), (np.exp2(np.arange(256) / 8) - 1).astype(np.float32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            grams = [ta.gram_hashes(ta.points(t), GRAM) for t in texts]
            which, place = probes(grams, [len(t) for t in texts], lambda g: value[table[(g & np.uint64(SLOTS - 1)).astype(np.int64)]])
            first = np.cumsum([0] + [len(g) for g in grams])
            marks = _signatures(texts)
            flat = np.concatenate(grams or [np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat[first[which] + place]),
                    batch.column(0).take(pa.array(which)),
                    pa.array(place.astype(np.int32)),
                    pa.array(np.array([len(t) for t in texts], np.int32)[which] if len(texts) else np.empty(0, np.int32)),
                    *(pa.array(m[which]) for m in marks),
                ],
                ["g", "train", "train_pos", "train_n", "train_m0", "train_m1", "train_m2", "train_m3"],
            )

    return run


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors: one pass over b with integers as wide as a."""
    if not a:
        return len(b)
    ones, where = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, last, score = ones, 0, 1 << (len(a) - 1), len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (ones & ~(diagonal | up)), up & diagonal
        score += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & ones
        up, down = ((fall << 1) & ones) | (ones & ~(diagonal | rise)), rise & diagonal
    return score


def _pair_counts(texts: list[str], bins: int = 256) -> np.ndarray:
    """Counts of character pairs, by a hash of the pair."""
    codes = ta.points("".join(texts)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = row[1:] == row[:-1]
    pair = (codes[:-1] * 31 + codes[1:] * 17 + (codes[1:] >> 5)) % bins
    return np.bincount((row[:-1] * bins + pair)[inside], minlength=bins * len(texts)).reshape(-1, bins).astype(np.int32)


def containment(evaluation: str, train: str) -> float:
    """Share of the evaluation text's distinct grams of five words (or of its own length) that the training text holds."""
    we, wt = ta.Words([evaluation]).value, ta.Words([train]).value
    n = min(WORDS, max(1, len(we)))
    ge = np.unique(ta.shingles(we, n))
    return float(np.isin(ge, ta.shingles(wt, n)).mean()) if len(ge) else 0.0


def _verify_edits(batches):
    """Of candidate pairs those within a tenth of edits; pairs must first contain enough of each other's character pairs."""
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep, edits, share = [], [], []
        for lo in range(0, len(a), 2000):
            x, y = a[lo : lo + 2000], b[lo : lo + 2000]
            longer = np.array([max(len(s), len(t)) for s, t in zip(x, y)])
            most = longer // TENTHS
            common = np.minimum(_pair_counts(x), _pair_counts(y)).sum(1)
            for i in np.flatnonzero(common >= longer - 1 - 2 * most).tolist():  # an edit spoils two pairs at most
                if (d := edit_distance(x[i], y[i])) <= most[i]:
                    keep.append(lo + i)
                    edits.append(d)
                    share.append(containment(x[i], y[i]))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(edits, pa.int32()), pa.array(share, pa.float64())], ["eval", "train", "edits", "containment"])


def _word_grams(shorter: tuple[int, ...] = ()):
    """A text's grams of five words, or of its own length if that is less, and those of each ``shorter`` length."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = []
            for t in texts:
                w = ta.Words([t]).value
                sizes = {min(WORDS, max(1, len(w)))} | {n for n in shorter if n <= len(w)}
                out.append(np.concatenate([np.unique(ta.shingles(w, n)).view(np.int64) for n in sorted(sizes)]))
            which = np.repeat(np.arange(len(texts)), [len(g) for g in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out or [np.empty(0, np.int64)])), batch.column(0).take(pa.array(which)), pa.array(np.array([len(g) for g in out], np.int32)[which] if out else np.empty(0, np.int32))], ["g", "class_id", "n_grams"])

    return run


def _short_lengths(batches):
    for batch in batches:
        counts = {max(1, len(ta.Words([t]).value)) for t in batch.column(1).to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(n for n in counts if n < WORDS), pa.int32())], ["n"])


def _verify_grams(batches):
    for batch in batches:
        share = [containment(e, t) for e, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], ["eval", "train", "containment"])


class Overlap:
    """Records in classes of equal text, and the links between evaluation and training classes."""

    def __init__(self, provenance: DataFrame, split_roles: DataFrame):
        self.spark = tune(provenance.sparkSession)
        rows = with_role(latest(provenance, "dataset", "source_split", "crop_sha256", "raw_text"), split_roles).where(F.col("role").isin("train", *EVALUATION))
        rows = rows.select("record_id", "role", F.coalesce("dataset", F.lit("")).alias("dataset"), plain_hash(F.col("crop_sha256")).alias("crop"), F.col("raw_text").cast("string").alias("raw_text"))
        rows = stage(rows.mapInArrow(_normalise, "record_id long, role string, dataset string, crop string, digest binary, plain string, n int"), "overlap-records")
        #: record_id, role, dataset, crop: the records that can take part.
        self.records = rows.select("record_id", "role", "dataset", "crop")
        long_enough = rows.where(F.col("n") >= MIN_CHARS)
        evaluation = F.col("role") != "train"
        side = lambda c: F.max(c.cast("int"))
        classes = long_enough.groupBy("digest").agg(F.min("record_id").alias("class_id"), F.first("plain").alias("plain"), side(evaluation).alias("in_eval"), side(~evaluation).alias("in_train"))
        classes = stage(classes, "overlap-classes")
        #: record_id, role, class_id: the class of equal text (its least record id) of each record.
        self.members = stage(long_enough.select("record_id", "role", "digest").join(classes.select("digest", "class_id"), "digest").drop("digest"), "overlap-members")
        self.eval_texts = classes.where("in_eval = 1").select("class_id", "plain")
        self.train_texts = classes.where("in_train = 1").select("class_id", "plain")
        self._near = None

    def _counts(self, grams: DataFrame) -> bytes:
        """How often the evaluation grams of each slot occur, as bytes; rows x ``ROW`` of them reach the driver."""
        slot = F.col("g").bitwiseAND(F.lit(SLOTS - 1))
        seen = grams.groupBy(F.shiftright(slot, 12).cast("int").alias("row"), slot.bitwiseAND(F.lit(ROW - 1)).cast("int").alias("low")).agg(F.count("*").alias("n"))
        rows = seen.groupBy("row").applyInArrow(_count_row, "row int, held binary").collect()
        table = bytearray(SLOTS)
        for r in rows:
            table[r["row"] * ROW : (r["row"] + 1) * ROW] = r["held"]
        return bytes(table)

    def near(self) -> DataFrame:
        """(eval, train, edits, containment): classes with different texts within a tenth of edits."""
        if self._near is None:
            ev = stage(self.eval_texts.mapInArrow(_eval_grams, "g long, eval long, eval_pos int, eval_n int, eval_m0 long, eval_m1 long, eval_m2 long, eval_m3 long"), "overlap-eval")
            table = self.spark.sparkContext.broadcast(self._counts(ev))  # SLOTS bytes
            tr = self.train_texts.mapInArrow(_train_grams(table), "g long, train long, train_pos int, train_n int, train_m0 long, train_m1 long, train_m2 long, train_m3 long")
            most = F.floor(F.greatest("eval_n", "train_n") / TENTHS)
            fit = (F.abs(F.col("eval_pos") - F.col("train_pos")) <= most) & (F.abs(F.col("eval_n") - F.col("train_n")) <= most) & (F.col("eval") != F.col("train"))
            fit = fit & apart("eval_m", "train_m", most)
            hits = ev.join(tr, "g").where(fit).groupBy("eval", "train").agg(F.count("*").alias("hits")).where(F.col("hits") >= HITS)
            self._near = stage(self._with_texts(hits.select("eval", "train")).mapInArrow(_verify_edits, "eval long, train long, edits int, containment double"), "overlap-near")
            release(ev)
        return self._near

    def links(self) -> DataFrame:
        """One row per linked pair of classes of different text, by their least record ids: edits and containment."""
        return self.near().select("eval", "train", "edits", F.round("containment", 6).alias("containment"))

    def _with_texts(self, pairs: DataFrame) -> DataFrame:
        left, right = self.eval_texts.toDF("eval", "eval_text"), self.train_texts.toDF("train", "train_text")
        return pairs.join(right, "train").join(left, "eval").select("eval", "train", "eval_text", "train_text")

    def contained(self, threshold: float = CONTAINED) -> DataFrame:
        """(eval, train, containment): training classes that hold at least ``threshold`` of an evaluation text's word grams."""
        kind = "g long, class_id long, n_grams int"
        ev = self.eval_texts.mapInArrow(_word_grams(), kind).withColumnRenamed("class_id", "eval")
        shorter = tuple(sorted(r.n for r in self.eval_texts.mapInArrow(_short_lengths, "n int").distinct().collect()))  # at most four
        tr = stage(self.train_texts.mapInArrow(_word_grams(shorter), kind).withColumnRenamed("class_id", "train").drop("n_grams"), "overlap-words")
        seen = tr.groupBy("g").agg(F.count("*").alias("df"))
        rank = F.row_number().over(Window.partitionBy("eval").orderBy("df", "g"))
        # A training text may miss this many of the grams, so one of the next rarest is in it.
        spare = F.floor(F.col("n_grams") * (1 - threshold) + 1e-9) + 1
        first = ev.join(seen, "g", "left").na.fill({"df": 0}).withColumn("rank", rank).where(F.col("rank") <= spare).where("df > 0")
        near = first.join(tr, "g").select("eval", "train").distinct()
        return self._with_texts(near).mapInArrow(_verify_grams, "eval long, train long, containment double").where(F.col("containment") >= threshold - 1e-9)

    def _sides(self, key: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        evaluation = F.col("role") != "train"
        return rows.where(evaluation).select(F.col("record_id").alias("e"), F.col(key).alias("ek")), rows.where(~evaluation).select(F.col("record_id").alias("t"), F.col(key).alias("tk"))

    def pairs(self) -> DataFrame:
        """(record_id_a, record_id_b), smaller first: equal crop, equal text or nearly equal text."""
        e, t = self._sides("crop", self.records.where("crop is not null"))
        crops = e.join(t, F.col("ek") == F.col("tk")).select("e", "t")
        e, t = self._sides("class_id", self.members)
        same = e.join(t, F.col("ek") == F.col("tk")).select("e", "t")
        near = self.near().join(e, F.col("eval") == F.col("ek")).join(t, F.col("train") == F.col("tk")).select("e", "t")
        return crops.union(same).union(near).select(F.least("e", "t").alias("record_id_a"), F.greatest("e", "t").alias("record_id_b")).distinct()

    def report(self) -> DataFrame:
        """Per evaluation split and dataset: records, and how many overlap by crop, by equal and by near text."""
        records, members = self.records, self.members
        crops = records.where("role = 'train' and crop is not null").select("crop").distinct().withColumn("by_crop", F.lit(1))
        texts = members.where("role = 'train'").select("class_id").distinct().withColumn("by_text", F.lit(1))
        near = self.near().select(F.col("eval").alias("class_id")).distinct().withColumn("by_near", F.lit(1))
        ev = records.where("role <> 'train'").join(crops, "crop", "left").join(members.select("record_id", "class_id"), "record_id", "left").join(texts, "class_id", "left").join(near, "class_id", "left").na.fill({"by_crop": 0, "by_text": 0, "by_near": 0})
        hit = F.greatest("by_crop", "by_text", "by_near")
        return ev.groupBy(F.col("role").alias("split_role"), "dataset").agg(F.count("*").alias("n_records"), *(F.sum(c).alias(c) for c in ("by_crop", "by_text", "by_near")), F.sum(hit).alias("n_overlapping"))

    def contained_records(self) -> DataFrame:
        """Per evaluation record with a class of training texts that contain it: how many classes, greatest containment."""
        per = self.contained().groupBy("eval").agg(F.count("*").alias("n_train_texts"), F.round(F.max("containment"), 6).alias("containment"))
        return self.members.where("role <> 'train'").join(per.withColumnRenamed("eval", "class_id"), "class_id").select("record_id", "role", "n_train_texts", "containment")
