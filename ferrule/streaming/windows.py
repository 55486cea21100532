"""Streams: counts over sliding windows, samples of what has passed, and leading tags.

The batch operators run on streams as they are where they need no more than
greatest values; the others keep their state in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import sketch
from ferrule.operators.relational import top_levels, values_by_count
from ferrule.sources import sinks


def sliding_distinct(events: DataFrame, ts: str, value: str, length: str = "30 seconds", slide: str = "10 seconds", late: str | None = None) -> DataFrame:
    """(window_start, window_end, estimate, approx): Flajolet-Martin and HyperLogLog counts of distinct values a window.

    With `late`, a watermark bounds the state of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, length, slide).alias("w")
    some = sketch.numbered(rows, value, sketch.FM_MODULUS).where("__x is not null")
    each = [F.max(c).alias(f"r{i}") for i, c in enumerate(sketch.fm_levels(F.col("__x")))]
    grouped = some.groupBy(w).agg(F.approx_count_distinct(value).alias("approx"), *each)
    levels = F.array(*[f"r{i}" for i in range(len(each))])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), sketch.fm_estimate(levels).alias("estimate"), "approx")


def exact_sliding_distinct(events: DataFrame, ts: str, value: str, length: str, slide: str) -> DataFrame:
    """(window_start, n): for batches; streams take no exact distinct counts."""
    return events.groupBy(F.window(ts, length, slide).alias("w")).agg(F.count_distinct(value).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def _batches(spark, path: str) -> list[int]:
    """Numbers of the batches whose tables stand complete in a folder, ascending."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


class Reservoir:
    """A uniform sample of a stream, of fixed size, with the number of rows so far.

    For foreachBatch.  A row's place is a seeded hash of its key; the sample is the `size` rows of the least
    places so far, which is uniform, however the stream is cut into batches.  All state is in `path`, a table a
    batch, with the number of rows so far beside the sample: a new process goes on from there, and a batch that is
    repeated starts again from the one before it, so that it counts once."""

    def __init__(self, size: int, key: str, path: str, seed: int = 3):
        self.size, self.key, self.path, self.seed = size, key, path, seed

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _batches(spark, self.path)
        before = [n for n in done if n < number]
        rows, seen = batch, batch.count()
        if before:
            last = spark.read.parquet(f"{self.path}/batch-{before[-1]}")
            seen += last.agg(F.max("__seen")).first()[0] or 0
            rows = rows.unionByName(last.drop("__seen"))
        sample = sketch.reservoir(rows.dropDuplicates([self.key]), self.size, self.key, self.seed)
        if seen or not before:
            sample.withColumn("__seen", F.lit(seen).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        for n in before[:-1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-{n}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _last(self, spark) -> DataFrame | None:
        done = _batches(spark, self.path)
        return spark.read.parquet(f"{self.path}/batch-{done[-1]}") if done else None

    def seen(self, spark) -> int:
        """How many rows have passed."""
        last = self._last(spark)
        return (last.agg(F.max("__seen")).first()[0] or 0) if last is not None else 0

    def sample(self, spark, schema) -> DataFrame:
        last = self._last(spark)
        return spark.createDataFrame([], schema) if last is None else last.drop("__seen")


def update_counts(counts: DataFrame, before: DataFrame, after: DataFrame, key: str, tags: str) -> DataFrame:
    """(tag, count) of the sample `after`, from the counts of the sample `before`: what came in is added, what went out
    taken away, and what stayed isn't read again but for its key."""
    came = after.join(before.select(key), key, "left_anti").select(F.explode(tags).alias("tag"), F.lit(1).alias("count"))
    went = before.join(after.select(key), key, "left_anti").select(F.explode(tags).alias("tag"), F.lit(-1).alias("count"))
    return counts.select("tag", "count").union(came).union(went).groupBy("tag").agg(F.sum("count").alias("count")).where("count > 0")


def keyword_stream(stream: DataFrame, text: str, keyword: str) -> DataFrame:
    """The events of a stream whose text holds a keyword, whatever its case."""
    return stream.where(F.contains(F.lower(F.col(text)), F.lit(keyword.lower())))


class WindowReport:
    """For foreachBatch: a line (Time, Ground Truth, Estimation) for each batch, behind those that are there."""

    def __init__(self, value: str, path: str):
        self.value, self.path = value, path

    def __call__(self, batch: DataFrame, number: int) -> None:
        one = sketch.fm_distinct(batch.select(F.lit(1).alias("__all"), F.col(self.value).cast("string").alias("__v")), ["__all"], "__v")
        truth = batch.agg(F.count_distinct(self.value).alias("Ground Truth"))
        row = truth.join(one.select(F.col("estimate").alias("Estimation")), how="left").fillna(0, ["Estimation"])
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("Time")
        sinks.append_csv(row.select(now, "Ground Truth", "Estimation"), self.path)


class TagReport:
    """For foreachBatch: a sample kept up by a Reservoir, and a block of its leading tags behind those in a local file."""

    def __init__(self, reservoir: Reservoir, tags: str, path: str, levels: int = 3):
        self.reservoir, self.tags, self.path, self.levels = reservoir, tags, path, levels

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.reservoir(batch, number)
        spark = batch.sparkSession
        sample = self.reservoir.sample(spark, batch.schema)
        sinks.append_tags(leading_tags(sample, self.tags, self.levels), self.reservoir.seen(spark), self.path)


def english_tags(events: DataFrame, tags: str) -> DataFrame:
    """Events that have tags, all of them ASCII."""
    ok = (F.size(tags) > 0) & F.forall(F.col(tags), lambda t: t.rlike(r"^[\x00-\x7F]*$"))
    return events.where(F.coalesce(ok, F.lit(False)))


def leading_tags(sample: DataFrame, tags: str, levels: int = 3) -> DataFrame:
    """(count, values): the tags of the greatest `levels` counts, all ties, in alphabetical order within a count."""
    counts = sample.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
    return values_by_count(top_levels(counts, levels), "tag").orderBy(F.desc("count"))


def start(stream: DataFrame, handle, checkpoint: str, seconds: int | None = 5):
    """Run a handler a micro-batch; restarted with the same checkpoint, a query goes on where it ended."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
