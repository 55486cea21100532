"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder that the session names; the driver deletes it when it ends.

    Where the session names none, as in tests, a folder under /tmp is used, but on a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/ferrule-checkpoints"
    mine = f"{root.rstrip('/')}/ferrule/{spark.sparkContext.applicationId}"
    if mine not in _mine:
        _mine.add(mine)
        atexit.register(_leave, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), mine)
    return f"{mine}/{uuid.uuid4().hex}"


_mine: set[str] = set()


def _leave(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the engine has gone already
        pass


#: Whether Spark deletes a query's shuffle files when the query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: the lineage ends there,
    and a lost executor costs no recomputation of what came before.

    What was shuffled for it is deleted once it is written; left to the driver's garbage collection,
    which doesn't know of executors' disks, it adds up over an operator's steps.
    `keep` collects the folder names, for drop().
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that materialise() wrote."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


#: Bits of a row number that are the row's place in its file.
PLACE = 40


def numbered(docs: DataFrame, columns: list[str | Column], name: str) -> DataFrame:
    """`columns` of `docs`, and in `name` a number for each row: the same whenever the table is read, rising with its order.

    A table that is Parquet files and nothing else stays where it is, and the number is made of the file's, by name,
    and the row's place in it; for that, the driver gets the files' names.  Anything else is written with its numbers."""
    spark = docs.sparkSession
    if not _is_files(docs):
        return materialise(docs.select(*columns, F.monotonically_increasing_id().alias(name)))
    file, place = (docs.metadataColumn("_metadata")[x] for x in ("file_path", "row_index"))
    files = sorted(r[0] for r in docs.select(file).distinct().collect())
    first = spark.createDataFrame([(f, i << PLACE) for i, f in enumerate(files)], "__file string, __first bigint")
    rows = docs.select(*columns, file.alias("__file"), place.alias("__place")).join(F.broadcast(first), "__file")
    return rows.withColumn(name, F.col("__first") + F.col("__place")).drop("__file", "__first", "__place")


def _is_files(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


#: Bits that say of a row, by a hash of its number, that it may be among some others.
BITS = 1 << 26
#: Rows that without() broadcasts; beyond it, it shuffles those that may be meant.
FEW_GONE = 200_000


def bits(ids: DataFrame) -> np.ndarray:
    """BITS bits, eight a byte, of which those of the `ids` are set, made in one task from one row a bit at most."""
    places = ids.select(F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("bit")).distinct()

    def run(batches):
        table = np.zeros(BITS, bool)
        for b in batches:
            table[b.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(table).tobytes(), 1)], pa.binary())], names=["t"])

    got = places.repartition(1).mapInArrow(run, "t binary").first()
    return np.zeros(BITS // 8, np.uint8) if got is None else np.frombuffer(zlib.decompress(got.t), np.uint8)


def maybe(docs: DataFrame, bits, *, on: str = "id", is_set: bool = True) -> DataFrame:
    """The rows whose bit is set: all that the bits were made of, and few others.  Or those whose bit isn't."""

    def run(batches):
        table = bits.value
        for batch in batches:
            last = batch.num_columns - 1
            bit = batch.column(last).to_numpy()
            yield batch.select(list(range(last))).filter(pa.array((table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 == 1) == is_set))

    return docs.withColumn("__bit", F.pmod(F.xxhash64(on), F.lit(BITS))).mapInArrow(run, docs.schema)


def without(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """The `rows` whose number `on` isn't in `gone`, a written table of numbers.

    Rows that stay aren't shuffled, but for the few whose number shares a bit with one that goes."""
    if gone.limit(FEW_GONE + 1).count() <= FEW_GONE:
        return rows.join(F.broadcast(gone), on, "left_anti")
    shared = rows.sparkSession.sparkContext.broadcast(bits(gone.select(F.col(on).alias("id"))))
    return maybe(rows, shared, on=on, is_set=False).unionByName(maybe(rows, shared, on=on).join(gone, on, "left_anti"))


#: Heaviest keys that split_join() broadcasts.
HUBS = 4096


def split_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """`rows` joined with `keyed`, which has one row for each key and in `weight` how many of `rows` have it.

    Rows of the HUBS heaviest keys meet a broadcast of that many rows and stay where they are; so none of the
    keys that are shuffled has more than a share of 1 / HUBS of the rows."""
    hubs = F.broadcast(keyed.orderBy(F.desc(weight), *on).limit(HUBS))
    rest = rows.join(hubs.select(*on), on, "left_anti").join(keyed, on)
    return rows.join(hubs, on).unionByName(rest)


def with_size(placed: DataFrame, place: list[str], **totals) -> DataFrame:
    """`placed` with __n, how many rows its place has, and sums of columns; places of a single row are left out."""
    sizes = placed.groupBy(*place).agg(F.count("*").alias("__n"), *[F.sum(c).alias(n) for n, c in totals.items()]).where("__n > 1")
    return split_join(placed, sizes, place, "__n")


def block_pairs(placed: DataFrame, place: list[str], who: str, block: int, weight: str | None = None, heaviest: int = 1) -> DataFrame:
    """Deal what meets at one place out to pairs of blocks.

    `placed` has one row for each place and `who`.  A place of n rows has
    ceil(n / block) blocks, by the hash of `who`, and as many at least as its
    `weight`, a column, has times `heaviest`; a row goes to every pair that its
    block is in.  Returns the columns of `placed` with p <= q, the pair, and mine,
    the row's own block, so that any two rows of a place meet in exactly one pair
    (rows of one block in the pair of that block with itself).  Places of a single
    row are left out.
    """
    dealt = with_size(placed, place, __w=weight or F.lit(0))
    n = F.greatest(F.ceil(F.col("__n") / block), F.least(F.ceil(F.col("__w") / heaviest), F.col("__n"))).cast("int")
    dealt = dealt.withColumns({"__b": n, "mine": F.pmod(F.xxhash64(who), n).cast("int")})
    dealt = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    return dealt.withColumns({"p": F.least("mine", "__o"), "q": F.greatest("mine", "__o")}).drop("__n", "__w", "__b", "__o")


class Forest:
    """Links that join what wasn't joined before."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b
