"""Jobs, their queue and their uploads as folds over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions import grammar as G

#: Queue events, the states they start from and the state they lead to.
TRANSITIONS = (
    ("enqueue", ("", "ready", "review", "exported", "failed", "cancelled", "interrupted"), "queued"),
    ("start", ("queued",), "running"),
    ("complete", ("running", "cancelling"), "review"),
    ("fail", ("running", "cancelling"), "failed"),
    ("cancel", ("queued",), "cancelled"),
    ("cancel", ("running",), "cancelling"),
    ("retry", ("failed", "cancelled", "interrupted"), "queued"),
    ("export", ("ready", "exported"), "exported"),
    ("review", ("review", "ready", "exported"), "ready"),
    ("restart", ("running", "cancelling"), "interrupted"),
)


def search(jobs: DataFrame, text: str) -> DataFrame:
    """Jobs whose source name holds the text, ASCII case ignored."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return jobs.where(F.instr(lower(F.col("source_name")), text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) > 0)


def page(jobs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the history, newest first (the page is the feature)."""
    return jobs.orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def current(jobs: DataFrame) -> DataFrame:
    """The newest row of each id (ties: latest received, then the lower status)."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("received_at"), "status")
    return jobs.where("id is not null").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def load(jobs: DataFrame, job_id: str) -> DataFrame:
    """The newest row of one job."""
    return current(jobs.where(F.col("id") == job_id))


def legal(state: Column, event: Column) -> Column:
    """The state after an event; unchanged where the event is not allowed."""
    out = None
    for name, states, to in TRANSITIONS:
        hit = (event == name) & state.isin(*states)
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out.otherwise(state)


#: All states, in the order in which maps over them are written.
STATES = ("", "queued", "running", "cancelling", "cancelled", "interrupted", "failed", "review", "ready", "exported")
BUSY, RESUMABLE = ("queued", "running", "cancelling"), ("cancelled", "interrupted", "failed")
#: Events of one job that are folded at once.
BLOCK = 1000


def refused(event: Column, state: Column, to: Column) -> Column:
    """The event changed nothing, and not because it leads to where the job is."""
    return (to == state) & ~((event == "export") & (state == "exported")) & ~((event == "review") & (state == "ready"))


def fold(events: DataFrame) -> DataFrame:
    """(job_id, state, n_events, n_illegal) after all events in (at, seq) order.

    Transitions compose: a run of events is a map from each of the ten states to the state
    after it and the refusals on the way. Events are folded in blocks of at most ``BLOCK`` per
    job and day of event time, then the blocks' maps are chained, so a job with most of the
    events is many small groups and one short list of maps.
    """
    known = events.where("job_id is not null").withColumn("day", F.to_date(F.col("at").cast("timestamp")) if events.schema["at"].dataType.typeName().startswith("timestamp") else F.floor(F.col("at") / BLOCK))
    number = F.row_number().over(Window.partitionBy("job_id", "day").orderBy("at", "seq"))
    blocks = known.withColumn("block", F.floor((number - 1) / BLOCK)).groupBy("job_id", "day", "block").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "event"))).alias("log"))
    start = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(0).alias("illegal")) for s in STATES))

    def step(maps: Column, x: Column) -> Column:
        return F.transform(maps, lambda m: G.let(legal(m["state"], x["event"]), lambda to: F.struct(to.alias("state"), (m["illegal"] + refused(x["event"], m["state"], to).cast("int")).alias("illegal"))))

    mapped = blocks.select("job_id", "day", "block", F.size("log").alias("n"), F.aggregate("log", start, step).alias("maps"))
    per = mapped.groupBy("job_id").agg(F.sum("n").cast("int").alias("n_events"), F.array_sort(F.collect_list(F.struct("day", "block", "maps"))).alias("chain"))
    begin = F.struct(F.lit("").alias("state"), F.lit(0).alias("illegal"))
    names = F.array(*map(F.lit, STATES))

    def follow(acc: Column, x: Column) -> Column:
        return G.let(F.get(x["maps"], (F.array_position(names, acc["state"]) - 1).cast("int")), lambda m: F.struct(m["state"].alias("state"), (acc["illegal"] + m["illegal"]).alias("illegal")))

    return per.withColumn("end", F.aggregate("chain", begin, follow)).select("job_id", "end.state", "n_events", F.col("end.illegal").alias("n_illegal"))


def group_of(state: Column) -> Column:
    """What a job can be asked for in its state."""
    return F.when(state.isin(*BUSY), "busy").when(state.isin(*RESUMABLE), "resumable").when(state == "ready", "ready").otherwise("idle")


def progress(page: Column, pages: Column, stage: Column, stages: Column, done: Column) -> Column:
    """Percent of a document's work: pages in each of one or two stages, in thousandths of a page."""
    position = (stage * pages + page) * 1000 + F.rint(1000 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), done)))
    return F.floor(100 * position / F.greatest(F.lit(1), pages * stages * 1000)).cast("int")


def uploads(received: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts (one per upload id) and conflicts (ids sent with more than one content)."""
    per = received.where("upload_id is not null").groupBy("upload_id").agg(F.min("sha256").alias("sha256"), F.countDistinct("sha256").alias("n"), F.count("*").alias("n_sent"))
    return per.where("n = 1").select("upload_id", "sha256", "n_sent"), per.where("n > 1").select("upload_id", F.col("n").alias("n_contents"))


def replayed(sent: DataFrame, receipts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(upload_id, sha256, outcome, job_id, stored_source_path) of uploads (upload_id, sha256).

    A known id with the same content gets its receipt again, with other content it is a
    conflict; receipts (upload_id, sha256, job_id) whose job is gone do not count.
    """
    held = receipts.select("upload_id", F.col("sha256").alias("held"), "job_id").join(jobs.select(F.col("id").alias("job_id"), "stored_source_path"), "job_id")
    outcome = F.when(F.col("held").isNull(), "new").when(F.col("held") == F.col("sha256"), "replay").otherwise("conflict")
    return sent.join(held, "upload_id", "left").select("upload_id", "sha256", outcome.alias("outcome"), "job_id", "stored_source_path")


def imported(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with the sources (id, source_name, source_path) that are not there yet, as imported.

    A source without an id is not imported. Jobs and sources meet in one window, not in a join:
    from its second import on a join would read a union, which Spark 4.1 plans as partitioned
    by id where both sides are, but may run with the partitions of both one after the other.
    """
    row = ("id", "source_name", "source_path", "status")
    new = sources.where("id is not null").withColumn("status", F.lit("imported")).select(*row, F.lit(False).alias("stored"))
    rows = jobs.select(*row, F.lit(True).alias("stored")).unionByName(new)
    return rows.withColumn("there", F.max("stored").over(Window.partitionBy("id"))).where("stored or not there").select(*row)


def drafts(saved: DataFrame) -> DataFrame:
    """The last draft of each job (job_id, saved_at, template): equal times go to the greater template."""
    return saved.where("job_id is not null").groupBy("job_id").agg(F.max(F.struct("saved_at", "template")).alias("d")).select("job_id", "d.saved_at", "d.template")


def write_checkpoints(checkpoints: DataFrame, path: str) -> None:
    """Put checkpoints (fingerprint, stage, page, digest, …) in place: a (fingerprint, stage) is replaced as a whole."""
    checkpoints.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint", "stage").parquet(path)


def resumable(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages that need no work: a checkpoint with the wanted fingerprint, stage and digest exists."""
    return wanted.join(checkpoints.select("fingerprint", "stage", "page", "digest").distinct(), ["fingerprint", "stage", "page", "digest"], "left_semi")
