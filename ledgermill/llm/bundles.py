"""Problem 5: splits that keep together what shares a document or a source group.

Borůvka-style contraction. The graph has one node per key (a document or a group, named
by its least record id) and one edge per distinct pair of keys that some record joins, so
a group that holds a third of the records is one node. In each round every node takes its
least edge (edges have a random total order), the taken edges go to the spanning forest,
trees are contracted to their roots by pointer doubling, and edges inside a tree vanish;
the number of nodes at least halves. All tables of a round are written to the shared
folder; nothing but row counts reaches the driver.

Splits. Bundles are dealt in size bands (powers of two), in hash order, systematically:
the i-th bundle of a band gets the split in whose interval the golden-ratio sequence's
i-th point lies, so every prefix of a band is close to the proportions. Bundles of more
than a fiftieth of the smallest split's room are at most 50 / least share; these are
placed one by one where most room is left, and the rest is dealt to the room that remains.

Cases. Keys are compared trimmed and in lower case; null, blank and filler keys link
nothing; a record without keys is its own bundle; a record loaded again counts once; null
record ids are left out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgermill.llm.overlap import latest, with_role
from ledgermill.session import release, stage, tune

#: Keys that stand for nothing.
FILLER = ("", "unknown", "n/a", "-", "none")
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
RANGE_ROWS = 20_000
GOLDEN = 0.6180339887498949


def plain_key(column: Column) -> Column:
    key = F.lower(F.trim(column.cast("string")))
    return F.when(key.isin(*FILLER), F.lit(None)).otherwise(key)


def counted(df: DataFrame, label: str, condition: Column) -> tuple[DataFrame, int]:
    """The staged table and how many of its rows meet a condition, observed while it is written."""
    seen = Observation()
    out = stage(df.observe(seen, F.sum(condition.cast("long")).alias("n")), label)
    return out, seen.get["n"] or 0


def components(edges: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(node, root) of every node of ``edges(u, v)``, and the spanning forest (u, v, round)."""
    order = F.xxhash64(F.lit(seed), F.least("u", "v"), F.greatest("u", "v"))
    yes = F.lit(True)
    left, n_edges = counted(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("w", order), "bundle-edges", yes)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct().withColumn("root", F.col("node"))
    forest = None
    step = 0
    while n_edges:
        step += 1
        both = left.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")).union(left.select("v", "u", "w", "u", "v"))
        picked = stage(both.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("m")).select("u", F.col("m.v").alias("to"), F.col("m.a").alias("a"), F.col("m.b").alias("b")), "bundle-picked")
        chosen = picked.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct().withColumn("round", F.lit(step))
        forest = chosen if forest is None else forest.union(chosen)
        # Two nodes that took the same edge point at each other; the lesser one is the root.
        other = picked.select(F.col("u").alias("to"), F.col("to").alias("back"))
        parent = stage(picked.select("u", "to").join(other, "to").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("p")), "bundle-parent")
        moved = 1
        while moved:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            far, moved = counted(parent.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "bundle-parent", F.col("moved"))
            release(parent)
            path = far._ledgermill_path
            parent = far.select("u", "p")
            parent._ledgermill_path = path
        # One join per round stays in the plan of the nodes; their number is the logarithm of the nodes at most.
        nodes = nodes.join(parent.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        a, b = parent.toDF("u", "pu"), parent.toDF("v", "pv")
        merged = left.join(a, "u").join(b, "v").where("pu <> pv").groupBy(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).agg(F.min("w").alias("w"))
        merged, n_edges = counted(merged, "bundle-edges", yes)
        release(left)
        left = merged
    if forest is None:
        forest = left.select("u", "v", F.lit(0).alias("round"))
    return stage(nodes, "bundle-nodes"), forest


class Bundles:
    """Records with their bundle; ``found()``, ``assign()`` and ``report()`` read it."""

    def __init__(self, provenance: DataFrame, split_roles: DataFrame, seed: int = 0):
        self.spark, self.seed = tune(provenance.sparkSession), seed
        rows = with_role(latest(provenance, "document_id", "source_group", "source_split"), split_roles)
        rows = stage(rows.select("record_id", "role", plain_key(F.col("document_id")).alias("doc"), plain_key(F.col("source_group")).alias("grp")), "bundle-records")
        joined = rows.groupBy("doc", "grp").agg(F.min("record_id").alias("r"))
        docs = joined.where("doc is not null").groupBy("doc").agg(F.min("r").alias("u"))
        groups = joined.where("grp is not null").groupBy("grp").agg(F.min("r").alias("v"))
        named = stage(joined.join(docs, "doc", "left").join(groups, "grp", "left").where("u is not null or v is not null").select("doc", "grp", F.coalesce("u", "v").alias("u"), F.coalesce("v", "u").alias("v")), "bundle-keys")
        nodes, self.forest = components(named.select("u", "v"), seed)
        least = nodes.groupBy("root").agg(F.min("node").alias("bundle_key"))
        keys = stage(named.join(nodes.withColumnRenamed("node", "u"), "u").join(least, "root").select("doc", "grp", "bundle_key"), "bundle-of-keys")
        match = rows["doc"].eqNullSafe(keys["doc"]) & rows["grp"].eqNullSafe(keys["grp"])
        self.records = stage(rows.join(keys, match, "left").select("record_id", "role", F.coalesce("bundle_key", "record_id").alias("bundle_key")), "bundle-members")

    def found(self) -> DataFrame:
        """(bundle_key, split_role): bundles whose records hold more than one of train, validation and test."""
        per = self.records.where(F.col("role").isin("train", "validation", "test")).groupBy("bundle_key", "role").agg(F.count("*").alias("n"))
        mixed = per.groupBy("bundle_key").agg(F.count("*").alias("roles")).where("roles > 1").select("bundle_key")
        return per.join(mixed, "bundle_key").select("bundle_key", F.col("role").alias("split_role"))

    def deal(self, splits: Sequence[tuple[str, float]] = SPLITS) -> DataFrame:
        """(bundle_key, n_records, band, split) of every bundle. Splits with a share of 0 get none."""
        splits = [(s, p) for s, p in splits if p > 0]
        if not splits:
            raise ValueError("no split has a share above 0")
        sizes = stage(self.records.groupBy("bundle_key").agg(F.count("*").alias("n_records")), "bundle-sizes")
        total, bundles = sizes.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.count("*")).first()
        norm = sum(p for _, p in splits)
        room = {s: p / norm * total for s, p in splits}
        giant = max(1.0, min(room.values()) / 50)
        placed = []
        for row in sizes.where(F.col("n_records") > giant).orderBy(F.desc("n_records"), "bundle_key").collect():  # at most 50 / least share rows
            best = max(room, key=lambda s: room[s])
            room[best] -= row["n_records"]
            placed.append((row["bundle_key"], row["n_records"], best))
        free = {s: max(0.0, r) for s, r in room.items()}
        rest = sum(free.values()) or 1.0
        bits = max(0, (bundles // RANGE_ROWS).bit_length())
        key = F.xxhash64(F.lit(self.seed), F.col("bundle_key"))
        small = sizes.where(F.col("n_records") <= giant).select("bundle_key", "n_records", F.floor(F.log2("n_records")).cast("int").alias("band"), key.alias("key")).withColumn("part", F.shiftright("key", 63 - bits))
        parts = small.groupBy("band", "part").agg(F.count("*").alias("n"))
        before = parts.select("band", "part", (F.sum("n").over(Window.partitionBy("band").orderBy("part")) - F.col("n")).alias("before"))
        place = F.row_number().over(Window.partitionBy("band", "part").orderBy("key", "bundle_key"))
        dealt = small.withColumn("place", place).join(before, ["band", "part"])
        point = ((F.col("before") + F.col("place")) * F.lit(GOLDEN) + F.pmod(F.xxhash64("band"), F.lit(1000)) / 1000.0) % 1.0
        dealt = dealt.withColumn("point", point)
        split, upto = None, 0.0
        for s, r in free.items():
            upto += r / rest
            split = F.when(F.col("point") < upto, s) if split is None else split.when(F.col("point") < upto, s)
        dealt = dealt.select("bundle_key", "n_records", "band", split.otherwise(max(free, key=free.get)).alias("split"))
        if placed:
            big = self.spark.createDataFrame(placed, "bundle_key long, n_records long, split string")
            dealt = dealt.unionByName(big.select("bundle_key", "n_records", F.floor(F.log2("n_records")).cast("int").alias("band"), "split"))
        return dealt

    def assign(self, splits: Sequence[tuple[str, float]] = SPLITS) -> DataFrame:
        """(record_id, bundle_key, split) of every record."""
        return self.records.select("record_id", "bundle_key").join(self.deal(splits).select("bundle_key", "split"), "bundle_key").select("record_id", "bundle_key", "split")

    def report(self, splits: Sequence[tuple[str, float]] = SPLITS) -> DataFrame:
        """Per split: bundles, records, target and actual share."""
        norm = sum(p for _, p in splits)
        target = self.spark.createDataFrame([(s, p / norm) for s, p in splits], "split string, target_share double")
        per = self.deal(splits).groupBy("split").agg(F.count("*").alias("n_bundles"), F.sum("n_records").alias("n_records"))
        out = target.join(per, "split", "left").na.fill({"n_bundles": 0, "n_records": 0})
        return out.withColumn("actual_share", F.round(F.col("n_records") / F.greatest(F.sum("n_records").over(Window.partitionBy()), F.lit(1)), 6))
