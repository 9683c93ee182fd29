"""Text extract, catalogue, stages and sinks."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from secondlook.session import SHUFFLE_CLEANUP, stage, stage_path
from secondlook.sources import tables as IO


def test_text_extract(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text('Data.Mth\tName\tQ\n 6 \t  \t"q""q"\nNA\tx y\t\n\t A \tNA\n')
    df = IO.read_text_extract(spark, str(path), ["Data.Mth", "Name", "Q"])
    assert df.columns == ["Data_Mth", "Name", "Q"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(
        [("6", None, 'q"q'), (None, "x y", None), (None, "A", None)], key=repr)


def test_catalog(spark, sf):
    catalog = IO.Catalog(spark, {"region": (f"{sf}/region.parquet", "r_regionkey int, r_name string")})
    assert catalog.names() == ["region"] and catalog.read("region").count() == 5
    with pytest.raises(KeyError):
        catalog.read("nowhere")


def test_stage_and_sink(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS fold")
    assert stage(df).count() == 10
    path = str(tmp_path / "parts")
    IO.write_parts(df, path, "fold")
    back = IO.load_stage(spark, path, "id long, fold int")
    assert back.filter("fold = 1").count() == 5
    with pytest.raises(Exception):
        IO.write_parts(df, path, "fold")  # a finished result is never overwritten


def test_a_stage_leaves_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before = shuffled()
    df = spark.range(200_000).select(F.xxhash64("id").alias("key")).groupBy("key").count()
    assert stage(df).count() == 200_000 and spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
    until = time.monotonic() + 20
    while (left := [p for p in shuffled() - before if p.exists() and p.stat().st_size > 100_000]) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert df.count() == 200_000  # can be computed again


def test_stage_folder_comes_from_the_session(spark):
    assert stage_path(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_lines_with_other_fields_are_set_aside(spark, tmp_path):
    """Short and long lines leave the result whole and are kept with their text; a quoted tab is no field's end."""
    path = tmp_path / "x.txt"
    path.write_text('A\tB\tC\n1\t2\t3\n1\t2\nNA\t"a\tb"\t\n1\t2\t3\t4\n\t\t\n  lonely  \n')
    names = ["A", "B", "C"]
    assert sorted((tuple(r) for r in IO.read_text_extract(spark, str(path), names).collect()), key=repr) == sorted(
        [("1", "2", "3"), (None, "a\tb", None)], key=repr)  # a line of tabs alone is a blank one
    assert IO.read_text_extract(spark, str(path), names).select("C").where("C IS NOT NULL").count() == 1
    bad = IO.bad_lines(spark, str(path), names)
    assert sorted(r.line.strip() for r in bad.collect()) == ["1\t2", "1\t2\t3\t4", "lonely"]
    assert {r.file for r in bad.collect()} == {"x.txt"} and bad.count() == 3
    (tmp_path / "y.txt").write_text("A\tB\tC\n1\t2\t3\n")
    assert IO.bad_lines(spark, str(tmp_path / "y.txt"), names).count() == 0
    with pytest.raises(Exception):
        IO.read_text_extract(spark, str(path), ["B", "A", "C"]).collect()


def test_runs_are_published_whole(spark, tmp_path):
    runs = IO.PublishedRuns(spark, str(tmp_path / "runs"))
    a, b = spark.range(10), spark.range(3).selectExpr("id", "'x' AS name")
    assert runs.published() == []

    def broken():
        yield "a", a
        yield "b", spark.range(5).selectExpr("raise_error('no')")

    class Tables(dict):
        def items(self):
            return broken()

    with pytest.raises(Exception):
        runs.publish("r1", Tables())
    assert runs.published() == [] and (tmp_path / "runs/runs/r1/a").exists()  # written, not seen
    with pytest.raises(KeyError):
        runs.read("r1", "a")
    assert runs.publish("r1", {"a": b, "b": a})  # what broke off is started anew
    assert runs.read("r1", "a").columns == ["id", "name"] and runs.read("r1", "b").count() == 10
    assert not runs.publish("r1", {"a": a}) and runs.read("r1", "a").count() == 3  # repeated without effect
    assert runs.publish("r2", {"a": a, "none": a.limit(0)}) and runs.published() == ["r1", "r2"]
    assert {(r.table, r.rows) for r in runs.manifest("r2").collect()} == {("a", 10), ("none", 0)}
    assert runs.read("r2", "none").count() == 0
    with pytest.raises(KeyError):
        runs.read("r2", "other")
    with pytest.raises(ValueError):
        runs.publish("a/b", {})
