"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, state string, city string"
PAIR = "user_id string, business_id string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; absent keys are null."""
    return spark.read.schema(schema).json(path)


def headed_csv(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(idx, attrs): lines of a number and comma-separated coordinates, without a header."""
    cells = F.split("value", ",")
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(cells[0].cast("bigint").alias("idx"), F.transform(F.slice(cells, 2, F.size(cells) - 1), lambda x: x.cast("double")).alias("attrs"))


def vector_chunks(spark: SparkSession, path: str) -> list[DataFrame]:
    """The files of a folder in the order of their names, a frame each; listed by Spark, so any store will do."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()
    return [vectors(spark, r.path) for r in files]


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): one a line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that is one JSON object of numbers."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,double>")))


def pair_model(spark: SparkSession, path: str, a: str, b: str) -> DataFrame:
    """(a, b, sim) of JSON lines with two keys and a similarity."""
    rows = spark.read.schema(f"{a} string, {b} string, sim double").json(path)
    return rows.select(F.col(a).alias("a"), F.col(b).alias("b"), "sim")


def table_model(spark: SparkSession, path: str) -> DataFrame:
    """A part of a model that was written as Parquet."""
    return spark.read.parquet(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of lines from a TCP server."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).format(kind).load(path)
