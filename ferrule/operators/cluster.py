"""Clustering of points (idx, attrs): K-Means, and the chunk by chunk scheme with discard, compressed and retained sets.

What is known of clusters (some multiples of k summaries) is on the driver;
points never are.  Distances are expressions over one broadcast row that holds
all summaries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.lineage import cut

Vector = list[float]


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def mahalanobis(point, mean, deviation) -> Column:
    """By a diagonal covariance; a dimension without deviation counts unscaled."""
    scaled = F.zip_with(F.zip_with(point, mean, lambda x, m: x - m), deviation, lambda d, s: d / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x * x))


def sum_statistics(points: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, pos, n, total, squares): sufficient statistics of each cluster and dimension."""
    long = points.select(tag, F.posexplode("attrs").alias("pos", "x"))
    return long.groupBy(tag, "pos").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.expr("x*x")).alias("squares"))


def _one_row(spark, table: list[tuple], schema: str) -> DataFrame:
    """Rows of a small table as one array column named `known`."""
    return F.broadcast(spark.createDataFrame([(table,)], f"known array<struct<{schema}>>"))


def assign(points: DataFrame, centroids: dict[int, Vector]) -> DataFrame:
    """`points` with tag and distance of the nearest centroid, the lesser tag of equals."""
    row = _one_row(points.sparkSession, sorted(centroids.items()), "tag: bigint, mean: array<double>")
    nearest = F.array_min(F.transform("known", lambda c: F.struct(squared_distance(F.col("attrs"), c["mean"]).alias("d"), c["tag"].alias("tag"))))
    out = points.crossJoin(row).withColumn("__n", nearest)
    return out.withColumns({"tag": F.col("__n.tag"), "distance": F.sqrt("__n.d")}).drop("known", "__n")


def farthest_first(points: DataFrame, k: int, seed: int = 0) -> dict[int, Vector]:
    """k starting centroids: a seeded first point, then always the point farthest from all chosen, least idx of equals."""
    first = points.orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(1).collect()
    chosen = {r.idx: list(r.attrs) for r in first}
    while chosen and len(chosen) < k:
        far = assign(points, chosen).agg(F.min(F.struct((-F.col("distance")).alias("d"), "idx", "attrs")).alias("p")).first().p
        if far is None or far.idx in chosen or far.d == 0:
            break
        chosen[far.idx] = list(far.attrs)
    return chosen


def random_start(points: DataFrame, k: int, seed: int = 0) -> dict[int, Vector]:
    """k starting centroids by a seeded hash."""
    return {r.idx: list(r.attrs) for r in points.orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(k).collect()}


def kmeans(points: DataFrame, k: int, *, rounds: int = 15, tolerance: float = 0.01, seed: int = 0, start: str = "farthest", centroids: dict[int, Vector] | None = None) -> tuple[DataFrame, dict[int, Vector]]:
    """Points with their tag, and the centroids.

    Ends when the root mean square shift of the centroids is at most `tolerance`; at 0, when nothing moves.  A
    cluster is named by the idx of its first centroid; one that loses all points is gone."""
    now = centroids or (farthest_first if start == "farthest" else random_start)(points, k, seed)
    if not now:
        return points.withColumns({"tag": F.lit(None).cast("bigint"), "distance": F.lit(None).cast("double")}), {}
    width = len(next(iter(now.values())))
    for _ in range(rounds):
        means = assign(points, now).groupBy("tag").agg(*[F.avg(F.col("attrs")[i]).alias(f"x{i}") for i in range(width)]).collect()
        new = {r.tag: [r[f"x{i}"] for i in range(width)] for r in means}
        shift = math.sqrt(sum((x - y) ** 2 for t in new for x, y in zip(new[t], now[t], strict=True)) / len(new))
        gone, now = len(now) - len(new), new
        if shift <= tolerance and not gone:
            break
    return assign(points, now), now


@dataclass
class Summary:
    n: int
    total: Vector
    squares: Vector

    def merged(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, [a + b for a, b in zip(self.total, other.total, strict=True)], [a + b for a, b in zip(self.squares, other.squares, strict=True)])

    @property
    def mean(self) -> Vector:
        return [x / self.n for x in self.total]

    @property
    def deviation(self) -> Vector:
        return [math.sqrt(max(0.0, q / self.n - (x / self.n) ** 2)) for x, q in zip(self.total, self.squares, strict=True)]

    def distance(self, point: Vector) -> float:
        return math.sqrt(sum(((x - m) / (s or 1.0)) ** 2 for x, m, s in zip(point, self.mean, self.deviation, strict=True)))


def summaries(tagged: DataFrame) -> dict[int, Summary]:
    """A summary a tag; as many rows as there are clusters come to the driver."""
    out: dict[int, Summary] = {}
    for r in sum_statistics(tagged).orderBy("tag", "pos").collect():
        out.setdefault(r.tag, Summary(r.n, [], [])).total.append(r.total)
        out[r.tag].squares.append(r.squares)
    return out


@dataclass
class Bfr:
    """State between chunks.  `members` maps points to tags; `retained` are the points of no cluster."""

    k: int
    seed: int = 0
    discard: dict[int, Summary] = field(default_factory=dict)
    compressed: dict[int, Summary] = field(default_factory=dict)
    merged_into: dict[int, int] = field(default_factory=dict)
    members: DataFrame | None = None
    retained: DataFrame | None = None
    stats: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def _threshold(self) -> float:
        return 4 * math.sqrt(len(next(iter(self.discard.values())).total))

    def _add(self, tagged: DataFrame) -> None:
        part = tagged.select("idx", "tag")
        self.members = cut(part if self.members is None else self.members.unionByName(part))

    def _split(self, points: DataFrame) -> None:
        """Cluster points into 3k; clusters of one point are retained, the others compressed."""
        tagged, _ = kmeans(points, 3 * self.k, seed=self.seed)
        tagged = cut(tagged)
        alone = tagged.groupBy("tag").agg(F.count("*").alias("n")).where("n = 1").select("tag")
        self.retained = cut(tagged.join(F.broadcast(alone), "tag", "left_semi").select("idx", "attrs"))
        groups = cut(tagged.join(F.broadcast(alone), "tag", "left_anti").select("idx", "attrs", "tag"))
        self.compressed.update(summaries(groups))
        self._add(groups)

    def _start(self, points: DataFrame) -> None:
        tenth = points.where(F.pmod(F.xxhash64("idx", F.lit(self.seed)), F.lit(10)) == 0)
        sample = tenth if tenth.limit(2 * self.k).count() >= 2 * self.k else points
        for attempt in range(10):
            tagged, _ = kmeans(sample, self.k, seed=self.seed + attempt)
            tagged = cut(tagged.select("idx", "attrs", "tag"))
            self.discard = summaries(tagged)
            if len(self.discard) >= self.k and min(s.n for s in self.discard.values()) > 1:
                break
        self._add(tagged)
        self._split(cut(points.join(tagged.select("idx"), "idx", "left_anti")))

    def _absorb(self, points: DataFrame, sets: dict[int, Summary]) -> DataFrame:
        """Give points to the nearest set within the threshold; returns the others.  Sets stay as they are until all points are seen."""
        if not sets:
            return points
        row = _one_row(points.sparkSession, [(t, s.mean, s.deviation) for t, s in sorted(sets.items())], "tag: bigint, mean: array<double>, deviation: array<double>")
        nearest = F.array_min(F.transform("known", lambda c: F.struct(mahalanobis(F.col("attrs"), c["mean"], c["deviation"]).alias("d"), c["tag"].alias("tag"))))
        tagged = cut(points.crossJoin(row).withColumn("__n", nearest).select("idx", "attrs", F.when(F.col("__n.d") < self._threshold(), F.col("__n.tag")).alias("tag")))
        taken = tagged.where("tag is not null")
        for tag, s in summaries(taken).items():
            sets[tag] = sets[tag].merged(s)
        self._add(taken)
        return tagged.where("tag is null").select("idx", "attrs")

    def _merge(self, sources: dict[int, Summary], targets: dict[int, Summary]) -> None:
        """Merge clusters whose smaller one's centroid is within the threshold of the larger, until none is."""
        again = True
        while again:
            again = False
            for a in sorted(sources):
                for b in sorted(targets):
                    if a not in sources or b not in targets or a == b:
                        continue
                    x, y = sources[a], targets[b]
                    small, large = (x, y) if x.n <= y.n else (y, x)
                    if large.distance(small.mean) < self._threshold():
                        targets[b] = y.merged(x)
                        del sources[a]
                        self.merged_into[a] = b
                        again = True

    def add(self, points: DataFrame, last: bool = False) -> None:
        """Take in a chunk of points (idx, attrs)."""
        points = cut(points.select("idx", "attrs"))
        if not self.discard:
            if not points.limit(1).count():
                return
            self._start(points)
        else:
            rest = self._absorb(points, self.discard)
            rest = self._absorb(rest, self.compressed)
            self.retained = cut(self.retained.unionByName(rest))
            if self.retained.limit(3 * self.k + 1).count() > 3 * self.k:
                self._split(self.retained)
            self._merge(self.compressed, self.compressed)
        if last:
            self._merge(self.compressed, self.discard)
            self._merge(self.compressed, self.compressed)
        self.stats.append((len(self.stats) + 1, len(self.discard), sum(s.n for s in self.discard.values()), len(self.compressed), sum(s.n for s in self.compressed.values()), self.retained.count()))

    def labels(self) -> DataFrame:
        """(idx, label): the discard set that a point ended in, -1 for compressed and retained ones."""
        spark = self.members.sparkSession

        def final(tag: int) -> int:
            while tag in self.merged_into:
                tag = self.merged_into[tag]
            return tag if tag in self.discard else -1

        tags = {*self.discard, *self.compressed, *self.merged_into}
        known = spark.createDataFrame([(t, final(t)) for t in sorted(tags)], "tag bigint, label bigint")
        inside = self.members.join(F.broadcast(known), "tag").select("idx", "label")
        return inside.unionByName(self.retained.select("idx", F.lit(-1).cast("bigint").alias("label")))


STATS = "round int, n_discard int, discard_points bigint, n_compressed int, compressed_points bigint, retained_points bigint"


def bfr(chunks: list[DataFrame], k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Labels of all points, and a row of figures a chunk; a single chunk is both first and last."""
    state = Bfr(k, seed)
    for i, chunk in enumerate(chunks):
        state.add(chunk, last=i == len(chunks) - 1)
    spark = chunks[0].sparkSession
    return state.labels(), spark.createDataFrame(state.stats, STATS)
