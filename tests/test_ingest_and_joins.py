"""The ledger of incremental ingest, malformed rows, sinks that are rerun, and joins on keys with nulls."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagframe.operators import dedupe, joins
from lagframe.plans.file_queries import _copy
from lagframe.plans.queries import QUERIES, SQL
from lagframe.sources import readers, writers
from lagframe.streaming.ingest import ingest_new, ledger, set_aside

from .compare import DATA, database, rows


def test_a_name_counts_once(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ledger"))
    take = lambda **more: ingest_new(spark, f"{source}/*", target, mark, "id long", **more)
    spark.range(10).coalesce(1).write.parquet(f"{source}/a")
    _copy(spark, f"{source}/a", f"{source}/b")  # in the same lot
    assert take() == 10
    _copy(spark, f"{source}/a", f"{source}/c")  # in a later one
    spark.range(10, 14).coalesce(1).write.parquet(f"{source}/d")
    assert take() == 4
    assert take() == 0
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(14))
    assert sorted((r.n, "/a/" in r.path) for r in ledger(spark, mark).collect()) == [(4, False), (10, True)]


def test_small_lots_hold_a_name_once(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ledger"))
    spark.range(40).repartition(4).write.parquet(f"{source}/a")
    _copy(spark, f"{source}/a", f"{source}/b")
    assert ingest_new(spark, f"{source}/*", target, mark, "id long", lot=1) == 40
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(40))
    assert len({r.batch for r in ledger(spark, mark).collect()}) == 4


def test_a_broken_file_is_set_aside(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ledger"))
    spark.range(6).coalesce(2).write.parquet(source)
    (tmp_path / "in" / "part-broken.parquet").write_text("no table")
    assert ingest_new(spark, source, target, mark, "id long") == 6
    assert [(r.name, r.length) for r in set_aside(spark, source, mark).collect()] == [("part-broken.parquet", 8)]
    assert ingest_new(spark, source, target, mark, "id long") == 0


def test_an_empty_table_is_not_broken(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ledger"))
    spark.range(0, 6, 1, 2).where("id > 2").write.parquet(source)  # the first task has no rows, and writes a file
    empty = next((tmp_path / "in").glob("part-00000*.parquet"))
    (tmp_path / "in" / "part-cut.parquet").write_bytes(empty.read_bytes()[:-20] + b"PAR1")
    (tmp_path / "in" / "part-text.parquet").write_text("PAR1")
    assert ingest_new(spark, source, target, mark, "id long") == 3
    assert {r.name: r.empty for r in set_aside(spark, source, mark).collect()} == {empty.name: True, "part-cut.parquet": False, "part-text.parquet": False}


def test_ingest_by_name_where_the_first_task_has_no_rows(spark):
    with_splits = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(with_splits)
    spark.conf.set(with_splits, "8k")  # the only row group lies in a later split
    try:
        got = QUERIES["ingest_by_name"](spark, DATA).toPandas()
    finally:
        spark.conf.set(with_splits, before)
    assert rows(got) == rows(database().sql(SQL["ingest_by_name"]).df())


def test_a_killed_run_repeats_its_lot(spark, tmp_path):
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "ledger"))
    spark.range(5).coalesce(1).write.parquet(source)
    fail = [True]

    def transform(df):
        out = df.withColumn("twice", F.col("id") * 2)
        if fail:
            out.write.mode("overwrite").parquet(f"{target}/batch=0")  # the lot is written, but the run ends before its commit
            raise RuntimeError("killed")
        return out

    with pytest.raises(Exception, match="killed"):
        ingest_new(spark, source, target, mark, "id long", transform)
    fail.clear()
    assert ingest_new(spark, source, target, mark, "id long", transform) == 5
    assert sorted((r.id, r.twice) for r in spark.read.parquet(target).collect()) == [(i, 2 * i) for i in range(5)]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\tday\tn\n1\t2020-01-01\t5\n2\tx\t5\n3\tNA\tNA\n4\t2020-01-02\n5\t2020-01-02\t6\tmore\n")
    (tmp_path / "b.tsv").write_text("k\tday\tn\n9\t2020-02-30\tz\n")
    checked = readers.read_checked(spark, f"file://{tmp_path}", "k long, day date, n int", pathGlobFilter="*.tsv")
    good = readers.set_malformed_apart(checked, f"file://{tmp_path}/bad").collect()
    assert sorted(map(tuple, good)) == [(1, dt.date(2020, 1, 1), 5), (3, None, None)]
    bad = spark.read.parquet(f"file://{tmp_path}/bad").collect()
    assert sorted((r.file[-5:], r.malformed) for r in bad) == [("a.tsv", "2\tx\t5"), ("a.tsv", "4\t2020-01-02"), ("a.tsv", "5\t2020-01-02\t6\tmore"), ("b.tsv", "9\t2020-02-30\tz")]
    assert sorted((r.file[-5:], r.n, r.malformed) for r in readers.malformed_counts(checked).collect()) == [("a.tsv", 5, 3), ("b.tsv", 1, 1)]


def test_a_sink_is_rerun_by_year(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = spark.range(0, 3000, 1, 16).select(F.date_add(F.lit("2019-01-01").cast("date"), F.pmod("id", F.lit(900)).cast("int")).alias("article_date"), "id")
    writers.write_articles(rows, path, rows=500)
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "a").rglob("*.parquet")]
    assert sum(sizes) == 3000 and max(sizes) <= 500 and len(sizes) < 3 * 16
    for _ in range(2):
        writers.write_articles(rows.where("year(article_date) = 2020 and id % 2 = 0"), path, replace=True)
    got = {r.article_year: r.n for r in spark.read.parquet(path).groupBy("article_year").agg(F.count("*").alias("n")).collect()}
    want = collections.Counter(r.y for r in rows.selectExpr("year(article_date) as y", "id").where("y <> 2020 or id % 2 = 0").collect())
    assert got == want


@pytest.mark.parametrize("null_match", [False, True])
def test_nullable_join(spark, null_match):
    left = [(i, None if i % 3 == 0 else f"k{i % 7}", "same") for i in range(300)]
    right = [(None, 1.5), (None, 2.5), ("k1", 3.0), ("k1", 4.0), ("k2", 5.0), ("none", 6.0)]
    a, b = spark.createDataFrame(left, "id long, k string, x string"), spark.createDataFrame(right, "k2 string, y double")
    out = joins.join_on_nullable(a, b, "k", "k2", null_match)
    assert out.columns == ["id", "k", "x", "k2", "y"]
    want = []
    for i, k, x in left:
        mates = [(r, y) for r, y in right if (k is not None and r == k) or (null_match and k is None and r is None)]
        want += [(i, k, x, *m) for m in mates or [(None, None)]]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_no_partition_has_all_null_keys(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        a = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
        b = spark.createDataFrame([(None, "n"), (10, "ten")], "k2 long, y string")
        for null_match in (False, True):
            out = joins.join_on_nullable(a, b, "k", "k2", null_match)
            sizes = out.where("k is null").groupBy(F.spark_partition_id()).count().toPandas()["count"]
            assert len(sizes) == 8 and sizes.max() < 0.4 * 3600
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keep_first_of_a_hot_key(spark):
    """One row a key leaves each task before the shuffle."""
    df = spark.range(0, 10000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.when(F.col("id") > 5, F.col("id")).alias("o"), F.col("id").alias("id"))
    first = dedupe.keep_first(df, ["k"], ["o", "id"])
    got = {r.k: r.id for r in first.collect()}
    assert len(got) == 3333 + 2 and got["hot"] == 0 and got[None] == 2 and got["7"] == 7
    plan = dedupe.keep_first(df, ["k"], ["o", "id"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "SortAggregate" not in plan, plan
