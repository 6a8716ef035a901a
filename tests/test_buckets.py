"""Bucketed tables: what a change rewrites, and changes that are run again."""

from __future__ import annotations

import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from dealforge.operators import buckets, upsert


def table(spark, at, n=2000, number=64):
    t = buckets.BucketedTable(spark, f"file://{at}/owners", ["ccn", "owner"], buckets=number)
    t.create(spark.range(n).select(F.col("id").cast("string").alias("ccn"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("o"), "id")).alias("owner"), F.lit("old").alias("name"), F.lit(1).alias("stars"), F.lit(None).cast("string").alias("updated_at")))
    return t


def files(at):
    return {p: p.stat().st_mtime_ns for p in pathlib.Path(at, "owners").rglob("*.parquet")}


def rows(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def change(spark, *new):
    return spark.createDataFrame(list(new), "ccn string, owner string, name string, stars int, updated_at string")


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    t = table(spark, tmp_path)
    before = files(tmp_path)
    assert len(before) == 64
    met = t.upsert("c1", change(spark, ("7", "o7", "new", 9, None)), ["name"], ("updated_at", F.lit("now")))
    after = files(tmp_path)
    assert len(met) == 1 and len(after) == 64
    assert [p.parent.name for p in set(after) - set(before)] == [f"_bucket={met[0]}"]
    assert all(after[p] == before[p] for p in set(after) & set(before)) and len(set(after) & set(before)) == 63
    got = {r.ccn: r for r in t.read().collect()}
    assert len(got) == 2000 and tuple(got["7"]) == ("7", "o7", "new", 1, "now") and got["8"].name == "old"


def test_equals_the_whole_upsert(spark, tmp_path):
    t = table(spark, tmp_path, number=16)
    base = t.read().persist()
    base.count()
    new = change(spark, ("1", "o1", "a", 2, None), ("10", None, "null key", 3, None), ("x", "y", "added", 4, "z"), ("x", "z", "added", 4, "z"))
    want = sorted(map(tuple, upsert.upsert(base, new, t.keys, ["name", "stars"]).collect()), key=str)
    t.upsert("c", new, ["name", "stars"])
    assert rows(t) == want and len(want) == 2003
    base.unpersist()


def test_run_again(spark, tmp_path, monkeypatch):
    """Broken off after each step, and run again: applied once."""
    t = table(spark, tmp_path, n=200, number=8)
    plus = lambda stored, new: stored.join(new.select("ccn", F.lit(True).alias("_hit")), "ccn", "left").withColumn("stars", F.col("stars") + F.coalesce(F.col("_hit").cast("int"), F.lit(0))).drop("_hit")
    some = change(spark, *((str(i), f"o{i}", "", 0, None) for i in (1, 2, 3)))
    write, broken = t._write, []

    def breaks(df, to, mode="dynamic"):
        write(df, to, mode)
        if not broken and to == t.path:
            broken.append(to)
            shutil.rmtree(next(pathlib.Path(tmp_path, "owners").glob("_bucket=*")))  # lost half way
            raise RuntimeError("lost")

    monkeypatch.setattr(t, "_write", breaks)
    with pytest.raises(RuntimeError):
        t.change("c", some, plus)
    lost = 200 - len(rows(t))
    assert lost
    met = t.change("c", some, plus)
    got = {r.ccn: r.stars for r in t.read().collect()}
    assert [got.get(str(i)) for i in (1, 2, 3)] == [2, 2, 2]
    before = files(tmp_path)
    assert t.change("c", some, plus) == met and files(tmp_path) == before  # done: nothing is written
    t.change("d", some, plus)
    assert {r.ccn: r.stars for r in t.read().collect()}["1"] == 3


def test_groups_and_absent(spark, tmp_path):
    m = buckets.BucketedTable(spark, f"file://{tmp_path}/owners", ["deal_id"], buckets=4, files=3)
    m.create(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "deal_id long, name string"))
    m.replace_groups("r", spark.createDataFrame([(1, "x"), (4, "y")], "deal_id long, name string"))
    m.insert_absent("i", spark.createDataFrame([(2, "no"), (5, "z")], "deal_id long, name string"))
    assert m.replace_groups("e", spark.createDataFrame([], "deal_id long, name string")) == []
    assert rows(m) == [(1, "x"), (2, "c"), (3, "d"), (4, "y"), (5, "z")]


def test_repeated_key_fails_and_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path, n=50, number=4)
    before = files(tmp_path)
    with pytest.raises(Exception, match="a key comes twice"):
        t.upsert("c", change(spark, ("1", "o1", "a", 1, None), ("1", "o1", "b", 1, None)), ["name"])
    assert files(tmp_path) == before
