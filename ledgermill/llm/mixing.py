"""Problem 7: mixing sources to target weights.

Weighted fair queueing. The documents of a source stand in a shuffled order (digest of
seed and id); a document's virtual finish time is the source's size up to and with it,
divided by the source's target share. A source's documents may come again, up to
``max_repeats`` times, after all of them came once. All finish times are put in one
global order by a range sort and cut where the running size would pass the budget, so
every source that can keep up ends at its share, and the room of an exhausted source goes
to the others in proportion to their weights.

Prefix sums are in two levels, so no source and no range of finish times is one task: in a
source the digests fall in equal ranges; the global order is written in ranges whose
bounds Spark samples from the finish times themselves, so they hold about equally many
rows however the times bunch. The ranges' totals are summed first and running sums are
taken inside each range. Only copies that may come before the cut are made.

Cases. Sources are compared trimmed and in lower case; documents of no listed source,
with a null id or a null source are not used; null and empty texts have size 0; rows
repeated with one id count once (the longest); a listed source without documents is
reported with 0; a null ``max_repeats`` means 1, a share of 0 or null uses nothing. Ties
of finish times go by source, copy and id. Empty tables give empty mixes.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.session import stage, tune

#: Fixed value: the split pattern that the public byte-level BPE vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows that one range of a prefix sum holds on average, and how many ranges there are at most.
RANGE_ROWS, MAX_RANGES = 50_000, 20_000
#: Sources in one target table; their totals are the only rows that reach the driver.
MAX_SOURCES = 100_000


def _counter(vocabulary):
    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
        count = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            tokens = [len(count(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["doc_id", "source", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every row with a public tokenizer's vocabulary file."""
    spark = tune(documents.sparkSession)
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(
        _counter(vocabulary), "doc_id long, source string, n_tokens long"
    )


def _name(column: str):
    return F.lower(F.trim(F.col(column).cast("string")))


class Mixture:
    """Builds the queue once; ``rows()``, ``report()`` and ``exhausted()`` read it.

    ``tokenizer`` is the vocabulary file that sizes are counted with; without one a document's
    size is its number of characters.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str | None, budget: int | None = None, seed: int = 0):
        self.spark = tune(documents.sparkSession)
        self.targets = (
            targets.select(_name("source").alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.greatest(F.lit(1), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1))).alias("max_repeats"))
            .where("source is not null")
            .groupBy("source")
            .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        )
        wanted = self.targets.select("source")
        own = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _name("source").alias("source"), F.col("text")).join(wanted, "source", "left_semi")
        counted = token_counts(own, tokenizer) if tokenizer else own.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
        self.sizes = stage(counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), F.min("source").alias("source")), "mix-sizes")
        totals = self.targets.join(self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"), F.max("n_tokens").alias("longest")), "source", "left").na.fill({"tokens": 0, "n_docs": 0, "longest": 0})
        self.totals = totals.limit(MAX_SOURCES + 1).collect()
        if len(self.totals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.total = sum(r["tokens"] for r in self.totals)
        self.budget = self.total if budget is None else budget
        self.seed, self.n_docs = seed, sum(r["n_docs"] for r in self.totals)
        self._rows = None

    def _known(self) -> DataFrame:
        """The sources with their targets and sizes (at most ``MAX_SOURCES`` rows)."""
        rows = [(r["source"], r["target_share"], r["max_repeats"], r["n_docs"], r["tokens"]) for r in self.totals]
        return self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_docs long, source_tokens long")

    def _horizon(self) -> float:
        """A virtual time by which the running size has passed the budget, or every source has ended."""
        live = [(r["tokens"] * r["max_repeats"], r["target_share"], r["longest"]) for r in self.totals if r["target_share"] > 0 and r["tokens"]]
        ends = sorted((t / w, t, w) for t, w, _ in live)
        done, pace, last = 0.0, sum(w for _, _, w in ends), 0.0
        for end, _, w in ends:
            if done + pace * (end - last) >= self.budget:
                break
            done, last, pace = done + pace * (end - last), end, pace - w
        else:
            return ends[-1][0] if ends else 0.0
        return last + (self.budget - done) / pace + max(n / w for _, w, n in live)

    def queue(self) -> DataFrame:
        """The copies of documents that may come before the cut, with their virtual finish times."""
        bits = min(14, max(0, (self.n_docs // RANGE_ROWS).bit_length()))
        key = F.md5(F.concat(F.lit(f"{self.seed}:"), F.col("doc_id").cast("string")))
        keyed = self.sizes.withColumn("key", key).withColumn("part", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - bits))
        parts = keyed.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
        before = parts.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
        inside = F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        once = keyed.withColumn("inside", inside).join(before, ["source", "part"]).select("source", "doc_id", "n_tokens", (F.col("before") + F.col("inside")).alias("upto"))
        horizon = self._horizon()
        horizon += 1e-6 * max(1.0, horizon)
        rounds = F.floor((F.lit(horizon) * F.col("target_share") - F.col("upto")) / F.greatest(F.col("source_tokens"), F.lit(1))) + 2  # one too many rather than too few
        copies = F.sequence(F.lit(1), F.least(F.col("max_repeats"), F.greatest(F.lit(1), rounds)).cast("int"))
        return (
            once.join(F.broadcast(self._known()), "source")  # at most MAX_SOURCES rows
            .where("target_share > 0")
            .select("source", "doc_id", "n_tokens", F.explode(copies).alias("copy"), "upto", "source_tokens", "target_share")
            .select("source", "doc_id", "copy", "n_tokens", ((F.col("source_tokens") * (F.col("copy") - 1) + F.col("upto")) / F.col("target_share")).alias("finish"))
            .where(F.col("finish") <= horizon)
        )

    def rows(self) -> DataFrame:
        """The mix: source, doc_id, copy, n_tokens, finish time and the running size up to the row."""
        if self._rows is None:
            ranges = min(MAX_RANGES, 1 + sum(r["n_docs"] * r["max_repeats"] for r in self.totals) // RANGE_ROWS)
            order = ["finish", "source", "copy", "doc_id"]
            queue = stage(self.queue().repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "mix-queue")
            parts = queue.groupBy("part").agg(F.sum("n_tokens").alias("n"))
            before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # at most MAX_RANGES rows
            running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            self._rows = (
                queue.withColumn("inside", F.sum("n_tokens").over(running))
                .join(F.broadcast(before), "part")
                .select("source", "doc_id", "copy", "n_tokens", "finish", (F.col("before") + F.col("inside")).alias("running"))
                .where(F.col("running") <= self.budget)
            )
        return self._rows

    def report(self) -> DataFrame:
        """Per listed source: target and actual share, sizes, repeats, and whether it was exhausted.

        A source is exhausted if every copy it may give is in the mix and all of them together
        are less than its share of the budget.
        """
        used = self.rows().groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_rows"), F.max("copy").alias("used_copies"))
        out = self._known().join(used, "source", "left").na.fill({"used_tokens": 0, "used_rows": 0, "used_copies": 0})
        whole = F.col("used_rows") == F.col("n_docs") * F.col("max_repeats")
        out = out.withColumn("exhausted", whole & (F.col("target_share") > 0) & (F.col("used_tokens") < F.col("target_share") * F.lit(float(self.budget))))
        total = F.sum("used_tokens").over(Window.partitionBy())  # a row for each source
        return out.withColumn("actual_share", F.round(F.col("used_tokens") / F.greatest(total, F.lit(1)), 6))

    def exhausted(self) -> DataFrame:
        """Sources of the mix whose copies all together give less than their share."""
        return self.report().where("exhausted").select("source")
