"""Streams give the batch result whatever order files come in."""

from pyspark.sql import functions as F

from pagemill.streaming import streams as S

SF = "/root/testdata/sf0.001"


def test_daily_counts_with_the_latest_days_first(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(3, F.desc("ts")).write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(tuple, events.groupBy(F.date_format("ts", "yyyy-MM-dd"), "event_type").count().collect()))
    run = tmp_path.name
    for _ in range(2):      # the second call resumes and finds nothing new
        got = S.stream_daily(spark, str(tmp_path), run=run, files_a_batch=1)
        assert sorted(map(tuple, got.collect())) == want


def test_usage_of_a_table_folder(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    assert S.stream_usage(spark, str(tmp_path)).agg(F.sum("event_count")).first()[0] == events.count()


def _beacons(spark):
    from pagemill.operators import admission as A
    from pagemill.sources import fixtures as FX

    judged = A.beacon_status(FX.beacons(spark, SF))
    return {r.status: r["count"] for r in judged.groupBy("status").count().collect()}


def _told(usage, rejected):
    return {204: usage.agg(F.sum("event_count")).first()[0], **{r.status: r["count"] for r in rejected.groupBy("status").count().collect()}}


def test_beacons_of_a_named_run_are_counted_once(spark, tmp_path):
    want = _beacons(spark)
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for _ in range(2):      # the second call resumes and finds nothing new
        assert _told(*S.stream_beacons(spark, str(tmp_path), run=tmp_path.name, files_a_batch=1)) == want


def test_a_batch_that_is_run_again_leaves_one_copy(spark, tmp_path):
    from pagemill.operators import usage as G
    from pagemill.sources import fixtures as FX

    batch = FX.beacons(spark, SF)
    for n in (0, 1, 0):
        S.write_beacons(batch.where(F.col("event_id") % 2 == n), n, str(tmp_path))
    read = lambda name: spark.read.parquet(str(tmp_path / name)).drop("batch_id")
    assert _told(G.merge_usage(read("accepted")), read("rejected")) == _beacons(spark)
    assert read("rejected").select("event_id").distinct().count() == read("rejected").count()
