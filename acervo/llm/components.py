"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def _done(links: DataFrame) -> bool:
    """Whether the links, each to a smaller id, are stars: every id has one link, and none to an id that has a link itself."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionAll(others)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that a link (a, b) names.

    Both stars hand a node's neighbours to the smallest of them, so that the links
    end as one star for each component. The links stay a table, every round is
    written to the shared folder in place of the one before, the result as well. Links to itself, repeated links and nulls do no harm.
    """
    links = stored(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    done = links.isEmpty()
    while not done:
        last, links = links, stored(_small_star(_large_star(links)).distinct())
        dropped(last)
        done = _done(links)
    found = links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    named = stored(found)
    dropped(links)
    return named
