"""Text extract, table catalogue, saved stages and partitioned sinks (SRC-*, SNK-*)."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secondlook.operators.schema import safe_names

MISSING = "NA"  # fixed value: beside blank fields, this text is read as missing


BAD_LINE = "_bad_line"


def read_text_extract(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated file with a header, every column text (SRC-1).

    Blank, all-space and ``NA`` fields are NULL and outer blanks are trimmed. Quoted
    line breaks are not accepted, so large files are still split over tasks. A header whose
    names differ from ``columns``, or stand in another order, is an error. Blank lines, of tabs alone too, are passed over. A line with fewer or more fields than the header is left
    out here; ``bad_lines`` has it.
    """
    raw = _lines(spark, path, columns)
    blank_free = raw.where(F.col(BAD_LINE).isNull()).select(
        *[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).alias(c) for c in columns])
    return blank_free.toDF(*safe_names(columns))


def bad_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The lines that ``read_text_extract`` leaves out, as they stand: (file, line). Write them beside the result for mending."""
    # Spark refuses to read the line alone, without a column
    some = F.length(BAD_LINE) >= -F.coalesce(F.length(f"`{columns[0]}`"), F.lit(0))
    return _lines(spark, path, columns).where(F.col(BAD_LINE).isNotNull() & some).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(BAD_LINE).alias("line"))


def _lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD_LINE]])
    # without pruning of columns, so that Spark counts the fields of each line
    return spark.read.option("columnPruning", "false").csv(
        path, schema=schema, enforceSchema=False, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True, nullValue=MISSING, columnNameOfCorruptRecord=BAD_LINE, mode="PERMISSIVE")


def write_text_extract(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote='"', escape='"', nullValue=MISSING,
                 emptyValue="")


class Catalog:
    """Named tables with declared schemas; nothing is inferred from data (SRC-2)."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, tuple[str, T.StructType | str]]):
        self._spark, self._tables = spark, dict(tables)

    def names(self) -> list[str]:
        return list(self._tables)

    def read(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"unknown table {name}; known: {self.names()}")
        path, schema = self._tables[name]
        df = self._spark.read.schema(schema).parquet(path)
        return df.toDF(*safe_names(df.columns))


def save_stage(df: DataFrame, path: str) -> None:
    """Save a finished frame for a later session (SRC-3, SRC-4)."""
    df.write.mode("errorifexists").parquet(path)


def load_stage(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_parts(df: DataFrame, path: str, *by: str) -> None:
    """Save a result table with one folder per value, e.g. per fold (SNK-2)."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


class PublishedRuns:
    """Tables that belong together, seen all or not at all (SNK-3).

    The tables of a run are written under ``folder/runs/<run>/<table>``. A run is published by its manifest, one
    small table under ``folder/manifests/<run>`` that is written last; Spark moves its only file into place when
    it is whole. Readers list manifests, so they never see a run that is half written. Repeating a run that broke off
    starts its tables anew; repeating a published one changes nothing. Works on any file system Spark writes to.
    """

    MANIFEST = "table string, rows long, columns string"

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def published(self) -> list[str]:
        """Names of published runs, in order."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/manifests")
        files = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        marks = files.globStatus(self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/manifests/*/_SUCCESS"))
        return sorted(m.getPath().getParent().getName() for m in marks)

    def publish(self, run: str, tables: Mapping[str, DataFrame]) -> bool:
        """Write ``tables`` as ``run`` and publish them; False if the run is published already."""
        if not run or "/" in run:
            raise ValueError(f"not a name for a run: {run!r}")
        if run in self.published():
            return False
        rows = []
        for name, df in tables.items():
            path = f"{self._folder}/runs/{run}/{name}"
            df.write.mode("overwrite").parquet(path)
            rows.append((name, self._spark.read.schema(df.schema).parquet(path).count(), df.schema.json()))
        manifest = self._spark.createDataFrame(rows, self.MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self._folder}/manifests/{run}")
        return True

    def manifest(self, run: str) -> DataFrame:
        """table, rows and columns (the schema) of a published run."""
        if run not in self.published():
            raise KeyError(f"{run} is not published")
        return self._spark.read.schema(self.MANIFEST).parquet(f"{self._folder}/manifests/{run}")

    def read(self, run: str, table: str) -> DataFrame:
        """A table of a published run."""
        found = self.manifest(run).where(F.col("table") == table).collect()
        if not found:
            raise KeyError(f"{run} has no table {table}")
        schema = T.StructType.fromJson(json.loads(found[0]["columns"]))
        return self._spark.read.schema(schema).parquet(f"{self._folder}/runs/{run}/{table}")
