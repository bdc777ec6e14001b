"""Adjacency queries over documents with arrays of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.kv import has_prefix
from lodestrata.operators.skew import lookup_join, split_join
from lodestrata.session import cut


def edges(docs: DataFrame, id: str, following: str | None = None, follower: str | None = None) -> DataFrame:
    """Distinct (src, dst): src follows dst. Ids without spaces around them; blanks and nulls do not count."""
    parts = []
    if following:
        parts.append(docs.select(F.trim(id).alias("src"), F.explode(F.transform(following, lambda x: F.trim(x))).alias("dst")))
    if follower:
        parts.append(docs.select(F.explode(F.transform(follower, lambda x: F.trim(x))).alias("src"), F.trim(id).alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("length(src) > 0 and length(dst) > 0").distinct()


def degrees(e: DataFrame, side: str) -> DataFrame:
    """(id, degree) counting edges by ``side``, 'src' or 'dst'."""
    return e.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def mutual(e: DataFrame) -> DataFrame:
    """(a, b), a < b, that follow each other: distinct edges, one shuffle on the unordered pair."""
    pair = e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")


def two_hop(e: DataFrame) -> DataFrame:
    """Distinct (src, dst) two steps apart, src itself left out."""
    a, b = e.select("src", F.col("dst").alias("mid")), e.select(F.col("src").alias("mid"), "dst")
    return split_join(a, b, "mid").where("src <> dst").select("src", "dst").distinct()


def k_hop(e: DataFrame, sources: Sequence[str], k: int) -> DataFrame:
    """(id, depth): ids reachable in at most k steps with the least number of steps.

    Level by level; each level keeps only new ids and is cut by a checkpoint.
    """
    spark = e.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in sources], "id string, depth int")
    frontier = seen
    for depth in range(1, k + 1):
        step = frontier.join(e, frontier["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def common_neighbours(e: DataFrame, least: int = 1, of: DataFrame | None = None) -> DataFrame:
    """(a, b, n): ids that both a and b follow, for a < b with at least ``least``.

    The pairs of followers of one id are as many as its degree squared.  With
    ``of``, a frame with the distinct ids asked for as ``id``, (a, b, n) of
    each of them, as a, with every other id, as b.
    """
    x, y = e.select(F.col("src").alias("a"), "dst"), e.select(F.col("src").alias("b"), "dst")
    if of is not None:
        x = lookup_join(x, of.select(F.col("id").alias("a")), "a")
    pairs = split_join(x, y, "dst").where("a < b" if of is None else "a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.where(F.col("n") >= least)


def triangles(e: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, connected pairwise whatever the direction.

    Each edge leads from the end of lower degree (then id) to the other, so a
    vertex has at most the square root of twice the edges behind it, however
    many it is connected with.
    """
    u = cut(e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degree = cut(u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    known = u
    for end in ("a", "b"):
        known = lookup_join(known, degree.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")), end)
    up = F.col("n_a") <= F.col("n_b")  # a < b, so equal degrees go by id
    out = known.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = split_join(out, out.withColumnRenamed("y", "z"), "x").where("y < z")
    closed = wedges.join(u.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"], "left_semi")
    ends = F.array_sort(F.array("x", "y", "z"))
    return closed.select(ends[0].alias("a"), ends[1].alias("b"), ends[2].alias("c"))


def edge_log(e: DataFrame) -> DataFrame:
    """Edges as keys 'e:<src>:<dst>', so that a prefix scan is an adjacency list."""
    return e.select(F.concat(F.lit("e:"), "src", F.lit(":"), "dst").alias("key"), "src", "dst")


def adjacency(log: DataFrame, src: str) -> DataFrame:
    """Edges of one vertex by key prefix."""
    return log.where(has_prefix(F.col("key"), f"e:{src}:"))
