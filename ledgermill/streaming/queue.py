"""The job queue and the upload receipts as streams.

The queue's state lives in keyed state: one small string per job, updated per micro-batch
in event order. Uploads are merged idempotently: a receipt is keyed by upload id, so a
replayed micro-batch changes nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgermill.operators.jobs import TRANSITIONS
from ledgermill.session import tune

TABLE = {(event, state): to for event, states, to in TRANSITIONS for state in states}
STATES = "job_id long, state string, n_events int, n_illegal int"
#: Events after which the target state equals the source by design, so they are no refusals.
IDLE = {("export", "exported"), ("review", "ready")}


def advance(state: str, n: int, refused: int, events: list[str]) -> tuple[str, int, int]:
    for event in events:
        to = TABLE.get((event, state))
        if to is None and (event, state) not in IDLE:
            refused += 1
        state = to if to is not None else state
    return state, n + len(events), refused


def _update(key, frames, held: GroupState):
    state, n, refused = held.get if held.exists else ("", 0, 0)
    log = pd.concat(list(frames)).sort_values(["at", "seq"])
    held.update(advance(state, int(n), int(refused), list(log["event"])))
    state, n, refused = held.get
    yield pd.DataFrame([(key[0], state, n, refused)], columns=["job_id", "state", "n_events", "n_illegal"])


def queue_states(events: DataFrame) -> DataFrame:
    """Streaming (job_id, state, n_events, n_illegal), updated as events (job_id, at, seq, event) arrive."""
    tune(events.sparkSession)
    return (
        events.where("job_id is not null and event is not null")
        .select("job_id", "at", "seq", "event")
        .groupBy("job_id")
        .applyInPandasWithState(_update, STATES, "state string, n int, refused int", "update", GroupStateTimeout.NoTimeout)
    )


def fits(limit_bytes: int = 40 << 20, limit_pixels: int = 80_000_000, limit_frames: int = 8, hours: int = 2) -> list[tuple[Column, str]]:
    """Conditions on one photo (n_bytes, width, height, frames, received_at, session_started), each with what it means to fail it."""
    return [
        (F.col("n_bytes").between(1, limit_bytes), "too_many_bytes"), (F.col("width").cast("long") * F.col("height") <= limit_pixels, "too_many_pixels"), (F.col("frames").between(1, limit_frames), "too_many_frames"),
        (F.col("received_at") <= F.col("session_started") + F.expr(f"interval {hours} hours"), "session_expired"),
    ]


def refusals(photos: DataFrame, per_session: int = 200) -> DataFrame:
    """(upload_id, reason) of photos that are not taken: over a limit, or after a session's first ``per_session`` that were."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), why) for ok, why in fits()))
    df = photos.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("session_id", F.col("reason").isNull()).orderBy("received_at", "upload_id"))
    return df.withColumn("reason", F.when(F.col("reason").isNull() & (place > per_session), "session_full").otherwise(F.col("reason"))).where("reason is not null").select("upload_id", "reason")


def admitted(photos: DataFrame) -> DataFrame:
    """Photos within the limits, each (upload_id, sha256) once within a day of event time.

    Limits on one photo are filters; the number of photos of a session is counted in ``refusals``.
    """
    kept = photos
    for ok, _ in fits():
        kept = kept.where(ok)
    return kept.withWatermark("received_at", "1 day").dropDuplicatesWithinWatermark(["upload_id", "sha256"])


def merge_receipts(batch: DataFrame, path: str) -> None:
    """For ``foreachBatch``: append receipts of ids not yet in the table; a repeat of an id is left alone.

    An id that comes with two contents, in the batch or against the table, is an error: nothing
    is written. Batches of one stream follow each other, so one writer is assumed.
    """
    spark = batch.sparkSession
    sent = batch.select("upload_id", "sha256").where("upload_id is not null").distinct()
    new = sent
    try:
        known = spark.read.parquet(path).select("upload_id", "sha256")
        new, sent = sent.join(known, "upload_id", "left_anti"), sent.unionByName(known)
    except AnalysisException as e:  # the table's first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    conflicts = [r[0] for r in sent.groupBy("upload_id").agg(F.countDistinct("sha256").alias("n")).where("n > 1").limit(5).collect()]
    if conflicts:
        raise ValueError(f"upload ids with more than one content, such as {conflicts}")
    new.write.mode("append").parquet(path)
