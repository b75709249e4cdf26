"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from alarmloom.operators.sizing import cut_lineage

# Links of which a round is one task; shuffles of so few rows would be all files and tasks.
ROUND_ROWS = 1 << 18


def _towards(edges: DataFrame) -> DataFrame:
    """Each vertex with the smallest of itself and its neighbours; combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_towards(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _towards(down)
    joined = down.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _both_stars(edges: DataFrame) -> DataFrame:
    """A large and a small star of links that are few: one partition, hence no shuffle."""
    m = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u")).alias("m")

    def pairs(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
        return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])))

    joined = pairs(edges.coalesce(1), ("u", "v"), ("v", "u")).select("u", "v", m).where("v > u")
    large = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).select("u", "v", m)
    return pairs(down, ("v", "m"), ("u", "m")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*").alias("n"), mark.alias("mark")).first())


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable), for all nodes that have a link.

    links has the bigint columns a and b. Every round replaces the links by fewer steps
    to the root; rounds end when nothing changes. Only counts reach the driver. Up to
    ROUND_ROWS links are one partition.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(_both_stars(edges) if state[0] <= ROUND_ROWS else _small(_large(edges)))
        new = _state(edges)
        if new == state:
            break
        state = new
    ends = F.array(*[F.struct(F.col(x).alias("node"), F.col("v").alias("root")) for x in ("u", "v")])
    return edges.select(F.inline(ends)).distinct()
