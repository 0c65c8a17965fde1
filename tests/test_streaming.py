"""Streams over folder tables: several micro-batches, replays and late rows."""

import datetime as dt
import time

from pyspark.sql import functions as F

from jobloom.plans import QUERIES
from jobloom.streaming import events as st
from tests.conftest import SF_SMALL


def folder_table(spark, tmp_path, parts=4):
    """The small events table as a folder of part files, in time order."""
    d = tmp_path / "sf"
    (spark.read.parquet(f"{SF_SMALL}/events.parquet").repartitionByRange(parts, "ts", "event_id")
     .sortWithinPartitions("ts", "event_id").write.parquet(str(d / "events.parquet")))
    return str(d)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_folder_and_file_give_the_same_rows(spark, tmp_path):
    d = folder_table(spark, tmp_path)
    for name in ("stream_ingest", "stream_dedup", "stream_recent"):
        want = rows(QUERIES[name](spark, SF_SMALL))
        assert want and rows(QUERIES[name](spark, d)) == want


def test_ingest_over_several_batches_and_a_replay(spark, tmp_path):
    d, out, ckpt = folder_table(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "ckpt")
    keys = ["user_id", "event_type"]
    run = lambda: st.run_to_end(st.ingest_first_seen(
        st.file_stream(spark, d, "events", max_files_per_trigger=1), keys, ["ts", "event_id"], out, ckpt))
    run()
    events = spark.read.parquet(f"{d}/events.parquet")
    got = spark.read.parquet(out)
    assert len(list((tmp_path / "ckpt" / "commits").glob("[0-9]*"))) >= 3
    assert got.count() == got.select(*keys).distinct().count() == events.select(*keys).distinct().count()
    before = rows(got.drop("batch", "bucket"))
    # the last batch is run again, as after a failure before its commit was noted
    commits = sorted((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert rows(spark.read.parquet(out).drop("batch", "bucket")) == before


def test_a_late_row_is_dropped_by_the_watermark_and_kept_by_ingest(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    names = schema.fieldNames()

    def event(i, user, day):
        r = dict.fromkeys(names)
        r.update(event_id=i, user_id=user, event_type="view", ts=base + dt.timedelta(days=day))
        return tuple(r[n] for n in names)
    d = tmp_path / "sf"
    for part in ([event(1, 1, 0), event(2, 2, 0)], [event(3, 3, 30), event(4, 1, 30)], [event(6, 5, 31)], [event(5, 4, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(d / "events.parquet"))
        time.sleep(1.2)             # files are taken in the order of their times
    stream = lambda: st.file_stream(spark, str(d), "events", max_files_per_trigger=1)
    out = str(tmp_path / "first")
    st.run_to_end(st.ingest_first_seen(stream(), ["user_id"], ["ts", "event_id"], out, str(tmp_path / "c1")))
    assert {(r.user_id, r.event_id) for r in spark.read.parquet(out).collect()} == {(1, 1), (2, 2), (3, 3), (4, 5), (5, 6)}
    out = str(tmp_path / "dedup")
    st.run_to_end(st.dedup_within_watermark(stream(), ["user_id"], "7 days", out, str(tmp_path / "c2")))
    ids = {r.event_id for r in spark.read.parquet(out).collect()}
    assert {1, 2, 3} <= ids and 5 not in ids


def test_missing_table_fails(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        st.file_stream(spark, str(tmp_path), "events")


def test_stream_dedup_one_row_per_key(spark):
    d = QUERIES["stream_dedup"](spark, SF_SMALL)
    assert d.count() == d.select("user_id", "event_type").distinct().count()
    assert d.where(F.col("user_id").isNull()).count() == 0


def test_the_earliest_event_of_a_session_wins_whatever_the_order(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    names = schema.fieldNames()

    def event(i, user, hour):
        r = dict.fromkeys(names)
        r.update(event_id=i, user_id=user, event_type="view", ts=base + dt.timedelta(hours=hour))
        return tuple(r[n] for n in names)
    d = tmp_path / "sf"
    # user 1: a session at hours 0 to 30 that arrives backwards, one much later; user 2: its first event comes last but in
    # time; user 3: too late for the watermark; the last part moves the watermark on
    for part in ([event(2, 1, 30), event(3, 2, 40)], [event(1, 1, 10), event(4, 1, 300)], [event(5, 1, 0), event(6, 2, 290)],
                 [event(7, 2, 20), event(8, 3, 295)], [event(9, 9, 900)], [event(12, 9, 905)], [event(10, 3, 1)], [event(11, 9, 1300)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(d / "events.parquet"))
        time.sleep(1.1)             # files are taken in the order of their times
    out = str(tmp_path / "out")
    st.run_to_end(st.first_of_sessions(st.file_stream(spark, str(d), "events", max_files_per_trigger=1), ["user_id"], ["ts", "event_id"],
                                       "2 days", "13 days", out, str(tmp_path / "c")))
    got = {(r.user_id, r.event_id, r.n_events) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 5, 3), (2, 7, 2), (1, 4, 1), (2, 6, 1), (3, 8, 1), (9, 9, 2)}


def test_one_file_a_bucket_and_batch(spark, tmp_path):
    d, out = folder_table(spark, tmp_path, 6), tmp_path / "out"
    st.run_to_end(st.ingest_first_seen(st.file_stream(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], str(out), str(tmp_path / "c")))
    assert all(len(list(b.glob("part-*.parquet"))) == 1 for b in out.glob("batch=*/bucket=*"))
