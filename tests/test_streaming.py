"""Known keys by Bloom filters, batches that are run again, and windows with state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dealforge.streaming import known, poll


def rows(spark, *ids):
    return spark.createDataFrame([(f"https://example.org/{i}", i) for i in ids], "url string, n int")


def store(spark, at, batches=6, size=300):
    s = known.KnownRows(spark, f"file://{at}/table", "url")
    for b in range(batches):
        s.add(rows(spark, *range(b * size, (b + 1) * size)).coalesce(1), b, size)
    return s


def test_most_files_are_left_out(spark, tmp_path):
    s = store(spark, tmp_path)
    assert len(s.files()) == 6
    _, files = s.candidates(rows(spark, *range(10_000, 10_200)))
    assert len(files) <= 1  # 1,200 tests of 0.0002
    passed, files = s.candidates(rows(spark, 5, 6, 650, 20_000))
    assert {f.rsplit("/", 2)[1] for f in files} >= {"_batch=0", "_batch=2"} and len(files) <= 3
    assert passed.count() >= 3
    assert sorted(r.n for r in s.unknown(rows(spark, 5, 6, 650, 20_000, 20_001)).collect()) == [20_000, 20_001]


def test_no_stored_key_is_missed(spark, tmp_path):
    """Files of many blocks and of few: every stored key passes its own file's filter, and few pass another's."""
    keys = spark.range(60_000).select(F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") < 100, "small").otherwise("large").alias("file"))
    filters = known.filters_of(keys, "url")
    assert {(r.file, r.level) for r in filters.collect()} == {("small", 0), ("large", 6)}
    hits = known.passing(keys, "url", filters, [0, 6]).join(keys.withColumnRenamed("file", "own"), "url")
    own, other = hits.filter("file = own").count(), hits.filter("file <> own").count()
    assert own == 60_000 and other < 60


def test_batch_run_again(spark, tmp_path):
    s = store(spark, tmp_path, batches=2, size=50)
    again = lambda: s.add(rows(spark, 10, 60, 100, 101), 2, 4)
    again()
    first = sorted(map(tuple, s.read().collect()))
    again()  # as after a failure before the batch was marked as done
    assert sorted(map(tuple, s.read().collect())) == first and len(first) == 102
    assert sorted(map(tuple, s.counts().select("_batch", "n_rows", "n_new").collect())) == [(0, 50, 50), (1, 50, 50), (2, 4, 2)]


def test_files_without_a_filter_are_read(spark, tmp_path):
    s = store(spark, tmp_path, batches=2, size=20)
    rows(spark, 500, 501).coalesce(1).write.parquet(f"{s.table}/_batch=7")  # its filters were never written
    assert sorted(r.n for r in s.unknown(rows(spark, 3, 500, 900)).collect()) == [900]


def test_nothing_stored(spark, tmp_path):
    s = known.KnownRows(spark, f"file://{tmp_path}/table", "url")
    assert s.unknown(rows(spark, 1, 2)).count() == 2
    s.add(rows(spark), 0, 0)
    s.add(rows(spark, 1), 1, 1)
    assert s.read().count() == 1 and s.counts().count() == 2


def test_windows_over_two_starts(spark, tmp_path):
    """State goes on from the checkpoint; windows are appended once closed, late rows left out and counted."""
    src, table, state = (f"file://{tmp_path}/{x}" for x in ("src", "table", "state"))
    day = lambda n, h=0: dt.datetime(2026, 1, 1) + dt.timedelta(days=n, hours=h)

    def land(*at):
        spark.createDataFrame([("a", t) for t in at], "kind string, at timestamp").coalesce(1).write.mode("append").parquet(src)
        q = poll.window_counts(poll.landed(spark, src, "kind string, at timestamp"), "at", "1 day", "kind", table=table, checkpoint=state, late="2 days").start()
        q.awaitTermination()
        closed = sorted((r.start, r.n) for r in spark.read.parquet(table).collect())
        still = sorted((r.start, r.n) for r in poll.open_windows(spark, state).collect())
        return closed, still, poll.late_groups(q)

    assert land(day(0), day(0, 5), day(2)) == ([], [(day(0), 2), (day(2), 1)], 0)
    assert land(day(0, 7), day(4)) == ([(day(0), 3)], [(day(2), 1), (day(4), 1)], 0)
    closed, still, late = land(day(0, 9), day(1), day(2, 1))
    assert closed == [(day(0), 3)] and still == [(day(2), 2), (day(4), 1)] and late == 2
