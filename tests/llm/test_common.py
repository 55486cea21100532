import os
import time

import pytest
from pyspark.sql import functions as F

from ferrule.llm import common


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    there = shuffle_files(spark)
    before = spark.conf.get(common.TIDY)
    kept = []
    out = common.materialise(spark.range(10_000).repartition(7, "id").groupBy("id").count(), keep=kept)
    for _ in range(20):
        if not (left := shuffle_files(spark) - there):
            break
        time.sleep(0.5)
    assert not left and out.count() == 10_000 and spark.conf.get(common.TIDY) == before
    common.drop(spark, kept)
    assert not kept


def test_rows_of_files_are_numbered_where_they_are(spark, tmp_path):
    path = f"{tmp_path}/a b%20é"
    spark.range(1000).selectExpr("id", "id % 3 as k", "'x' as _metadata").repartition(3, "id").write.partitionBy("k").parquet(path)
    top = os.path.dirname(common.shared_dir(spark))
    os.makedirs(top, exist_ok=True)
    before = set(os.listdir(top))
    docs = spark.read.parquet(path)
    rows = common.numbered(docs, ["id", "k"], "n")
    got = {r.id: r.n for r in rows.collect()}
    assert rows.columns == ["id", "k", "n"] and len(got) == len(set(got.values())) == 1000
    assert got == {r.id: r.n for r in rows.select("n", "id").repartition(5).collect()}
    assert not set(os.listdir(top)) - before
    # in the order of the files' names, and of the rows in them
    order = sorted(docs.select("id", docs.metadataColumn("_metadata").file_path.alias("f"), docs.metadataColumn("_metadata").row_index.alias("i")).collect(), key=lambda r: (r.f, r.i))
    assert sorted(got, key=got.get) == [r.id for r in order]
    # rows that come twice out of one place in a file, or out of none, are numbered in a written table
    for other, n in ((docs.union(docs), 2000), (docs.select("id", F.explode(F.array(F.lit(1), F.lit(2)))), 2000), (spark.range(7), 7), (docs.where("id < 0"), 0)):
        assert common.numbered(other, ["id"], "n").agg(F.countDistinct("n")).first()[0] == n
    assert common.numbered(spark.read.schema("id long").parquet(path), ["id"], "n").agg(F.countDistinct("n")).first()[0] == 1000
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert common.numbered(spark.read.parquet(f"{tmp_path}/none"), ["id"], "n").count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_without(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_GONE", few)
    rows = spark.range(5000).selectExpr("id << 40 as n", "array(id) as a", "id as bit")
    for gone in (rows.where("bit % 7 = 0").select("n"), rows.where("bit < 0").select("n")):
        left = {r.n for r in rows.collect()} - {r.n for r in gone.collect()}
        got = common.without(rows, gone, "n")
        assert got.columns == rows.columns
        assert sorted((r.n, r.a, r.bit) for r in got.collect()) == sorted((n, [n >> 40], n >> 40) for n in left)
