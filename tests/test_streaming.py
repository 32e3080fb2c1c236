from datetime import datetime, timedelta

from ledgermill.operators.jobs import fold
from ledgermill.plans.workflow import queue_events
from ledgermill.streaming import queue


def test_queue_stream_equals_batch(spark, sf, tmp_path):
    events = queue_events(spark, sf).cache()
    schema = events.schema
    cut = events.approxQuantile("seq", [0.3, 0.7], 0.0)
    parts = [events.where(f"seq < {cut[0]}"), events.where(f"seq >= {cut[0]} and seq < {cut[1]}"), events.where(f"seq >= {cut[1]}")]
    source = str(tmp_path / "in")
    latest = {}

    def take(batch, _):
        latest.update({r.job_id: (r.state, r.n_events, r.n_illegal) for r in batch.collect()})

    for part in parts:  # each part is a micro-batch of a restarted query
        part.coalesce(1).write.mode("append").parquet(source)
        q = queue.queue_states(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(take).trigger(availableNow=True).start()
        q.awaitTermination()
    assert latest == {r.job_id: (r.state, r.n_events, r.n_illegal) for r in fold(events).collect()}


def test_receipts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "receipts")
    a = spark.createDataFrame([("u1", "x"), ("u1", "x"), ("u2", "y")], "upload_id string, sha256 string")
    queue.merge_receipts(a, path)
    queue.merge_receipts(a.union(spark.createDataFrame([("u3", "z")], a.schema)), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("u1", "x"), ("u2", "y"), ("u3", "z")]


def test_conflicting_receipts_are_refused(spark, tmp_path):
    import pytest

    path = str(tmp_path / "receipts")
    frame = lambda rows: spark.createDataFrame(rows, "upload_id string, sha256 string")
    with pytest.raises(ValueError, match="u1"):
        queue.merge_receipts(frame([("u1", "x"), ("u1", "y")]), path)
    queue.merge_receipts(frame([("u1", "x"), (None, "y")]), path)
    with pytest.raises(ValueError, match="u1"):
        queue.merge_receipts(frame([("u1", "y"), ("u2", "z")]), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("u1", "x")]


PHOTO = "upload_id string, sha256 string, session_id string, n_bytes long, width int, height int, frames int, received_at timestamp, session_started timestamp"


def photo(i, at, sha="x", session="s", n_bytes=10, width=100, height=100, frames=1, started=datetime(2030, 1, 1)):
    return (i, sha, session, n_bytes, width, height, frames, at, started)


def test_admitted(spark, tmp_path):
    at = datetime(2030, 1, 1)
    rows = [photo("u1", at), photo("u1", at + timedelta(hours=1)), photo("u2", at, n_bytes=1 << 30), photo("u3", at, width=10_000, height=8_001), photo("u4", at, frames=9), photo("u5", at + timedelta(hours=3))]
    spark.createDataFrame(rows, PHOTO).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PHOTO).parquet(str(tmp_path / "in"))
    q = queue.admitted(stream).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.upload_id for r in spark.table("admitted").collect()] == ["u1"]


def test_refusals(spark):
    at = datetime(2030, 1, 1)
    rows = [photo("a", at, n_bytes=None), photo("b", at, width=10_000, height=8_001), photo("c", at, frames=9), photo("d", at + timedelta(hours=3)), photo("e", at), photo("f", at + timedelta(minutes=1)), photo("g", at + timedelta(minutes=2)), photo("h", at, session="t")]
    got = {r.upload_id: r.reason for r in queue.refusals(spark.createDataFrame(rows, PHOTO), per_session=2).collect()}
    assert got == {"a": "too_many_bytes", "b": "too_many_pixels", "c": "too_many_frames", "d": "session_expired", "g": "session_full"}


def test_checkpoints_are_replaced_by_stage(spark, tmp_path):
    from ledgermill.operators import jobs

    path = str(tmp_path / "checkpoints")
    frame = lambda rows: spark.createDataFrame(rows, "fingerprint string, stage string, page int, digest string")
    jobs.write_checkpoints(frame([("f", "primary", 0, "a"), ("f", "primary", 1, "b"), ("f", "second", 0, "c")]), path)
    jobs.write_checkpoints(frame([("f", "primary", 0, "z")]), path)
    held = spark.read.parquet(path)
    assert sorted((r.stage, r.page, r.digest) for r in held.collect()) == [("primary", 0, "z"), ("second", 0, "c")]
    wanted = frame([("f", "primary", 0, "z"), ("f", "second", 0, "other")])
    assert [(r.stage, r.page) for r in jobs.resumable(held, wanted).collect()] == [("primary", 0)]


def test_queue_blocks_compose(spark, monkeypatch):
    import random

    from ledgermill.operators import jobs

    rng = random.Random(1)
    kinds = sorted({e for e, *_ in jobs.TRANSITIONS})
    at = datetime(2030, 1, 1)
    events = [(j, at + timedelta(hours=rng.randint(0, 90)), i, rng.choice(kinds)) for i in range(600) for j in (1, 2)]
    df = spark.createDataFrame(events, "job_id long, at timestamp, seq long, event string")
    want = {}
    for j in (1, 2):
        log = [e for *_, e in sorted((a, s, e) for jj, a, s, e in events if jj == j)]
        want[j] = queue.advance("", 0, 0, log)
    for block in (7, 1000):
        monkeypatch.setattr(jobs, "BLOCK", block)
        assert {r.job_id: (r.state, r.n_events, r.n_illegal) for r in jobs.fold(df).collect()} == want


def test_drafts(spark):
    from ledgermill.operators import jobs

    df = spark.createDataFrame([("j", "1", "a"), ("j", "2", "b"), ("j", "2", "c"), (None, "3", "x"), ("k", None, None)], "job_id string, saved_at string, template string")
    assert {(r.job_id, r.template) for r in jobs.drafts(df).collect()} == {("j", "c"), ("k", None)}
