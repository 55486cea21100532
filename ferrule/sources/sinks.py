"""Writers and the formats of reports.

Tables are written by Spark, wherever the path is.  Only results of a few values
come to the driver, to be one JSON object.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.itemsets import report_lines


def json_object(one_row: DataFrame, path: str) -> None:
    """The single row of a frame as one JSON object in a local file."""
    with open(path, "w") as f:
        json.dump(one_row.first().asDict(recursive=True), f)


def csv_with_header(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def table(rows: DataFrame, path: str) -> None:
    """A part of a model as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def named_pairs(model: DataFrame, names: DataFrame, number: str, name: str) -> DataFrame:
    """Pairs (a, b) of numbers as pairs of names."""
    x, y = (names.select(F.col(number).alias(k), F.col(name).alias(f"__{k}")) for k in "ab")
    return model.join(x, "a").join(y, "b").drop("a", "b").withColumnsRenamed({"__a": "a", "__b": "b"})


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """Candidates, then frequent itemsets, one line a size and an empty line behind each; few lines, in one local file."""
    with open(path, "w") as f:
        for title, sets in (("Candidates:", candidates), ("Frequent Itemsets:", frequent)):
            f.write(f"{title}\n")
            for r in report_lines(sets).orderBy("size").toLocalIterator():
                f.write(f"{r.line}\n\n")


def community_line(members) -> Column:
    """'a', 'b'"""
    return F.concat(F.lit("'"), F.array_join(F.transform(members, lambda x: x.cast("string")), "', '"), F.lit("'"))


def betweenness_line(u, v, value) -> Column:
    """('a', 'b'), 1.5"""
    return F.concat(F.lit("('"), u.cast("string"), F.lit("', '"), v.cast("string"), F.lit("'), "), value.cast("string"))


def bit_string(rows: DataFrame, order: str, bit: str) -> DataFrame:
    """(bits): all bits in order, parted by spaces.  For reports: the whole vector is one value."""
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(bit).cast("string").alias("b")))), lambda x: x["b"]), " ").alias("bits"))


def append_csv(rows: DataFrame, path: str) -> None:
    """For foreachBatch: rows behind those that are there."""
    rows.write.mode("append").option("header", True).csv(path)


def betweenness_file(edges: DataFrame, path: str) -> None:
    """Edges (u, v, betweenness) as lines of one local file, highest first, then by both ends; read from the engine bit by bit."""
    rows = edges.orderBy(F.desc("betweenness"), "u", "v").select(betweenness_line(F.col("u"), F.col("v"), F.col("betweenness")).alias("line"))
    with open(path, "w") as f:
        for r in rows.toLocalIterator():
            f.write(f"{r.line}\n")


def label_object(labels: DataFrame, path: str, idx: str = "idx", label: str = "label") -> None:
    """{"idx": label} in the order of idx, as one local JSON file, written bit by bit."""
    with open(path, "w") as f:
        f.write("{")
        for i, r in enumerate(labels.orderBy(idx).select(idx, label).toLocalIterator()):
            f.write(f"{', ' if i else ''}{json.dumps(str(r[0]))}: {r[1]}")
        f.write("}")


def round_csv(stats: DataFrame, path: str) -> None:
    """The figures of a chunked clustering, six whole numbers a round, under their header in one local file."""
    names = ("round", "n_discard", "discard_points", "n_compressed", "compressed_points", "retained_points")
    with open(path, "w") as f:
        f.write("round_id,nof_cluster_discard,nof_point_discard,nof_cluster_compression,nof_point_compression,nof_point_retained\n")
        for r in stats.orderBy("round").toLocalIterator():
            f.write(",".join(str(r[n]) for n in names) + "\n")


def append_tags(levels: DataFrame, seen: int, path: str) -> None:
    """A block of leading tags (count, values) behind those in a local file, most frequent first."""
    with open(path, "a") as f:
        f.write(f"The number of tweets with tags from the beginning: {seen}\n")
        for r in levels.orderBy(F.desc("count")).toLocalIterator():
            f.writelines(f"{tag}  : {r['count']}\n" for tag in r["values"])
        f.write("\n")


def profile_model(items: DataFrame, users: DataFrame, path: str) -> None:
    """Profiles of items (doc, word ...) and of users as the two tables of a model."""
    for name, part in (("business_profile", items), ("user_profile", users)):
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def read_profile_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Item and user profiles that profile_model() wrote."""
    return spark.read.parquet(f"{path}/business_profile"), spark.read.parquet(f"{path}/user_profile")
