"""Point-in-time histories: the newest events of a user before each of the user's events.

Users are not gathered: events are cut into ranges of (user, time), and a range takes over
from the ranges before it only the newest ``depth`` events of its first user. One user may
span any number of ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convfeat.operators.distribution import CHUNK, range_chunks

USER, ORDER = "user_id", ["event_ts", "event_id"]


def _newest(old: Column, new: Column, depth: int) -> Column:
    """The last ``depth`` of two lists in time order, newest first."""
    joined = F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()))
    return F.slice(F.reverse(joined), 1, depth)


def _range_ends(chunks: DataFrame) -> DataFrame:
    """(range, user) for the first and last user of each range: at most two rows per range."""
    ends = chunks.groupBy(CHUNK).agg(F.min(USER).alias("lo"), F.max(USER).alias("hi"))
    return ends.select(CHUNK, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(USER))


def _carried(chunks: DataFrame, event: Column, domains: Sequence[str], depth: int) -> DataFrame:
    """Per range end: ``__old_<domain>``, the user's newest events in the ranges before."""
    ends = _range_ends(chunks)
    backwards = Window.partitionBy(USER, CHUNK, "domain").orderBy(*[F.desc(c) for c in ORDER])
    tails = (
        chunks.join(ends, [CHUNK, USER], "left_semi")
        .withColumn("__rank", F.row_number().over(backwards))
        .filter(F.col("__rank") <= depth)
        .select(USER, "domain", CHUNK, *ORDER, event.alias("__event"))
    )
    ordered = Window.partitionBy(USER, "domain").orderBy(CHUNK, *ORDER).rowsBetween(1 - depth, 0)
    states = (
        tails.withColumn("__list", F.collect_list("__event").over(ordered))
        .groupBy(USER, "domain", CHUNK)
        .agg(F.max_by("__list", F.struct(*ORDER)).alias("__state"))
    )
    grid = ends.select(USER, CHUNK, F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    earlier = Window.partitionBy(USER, "domain").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    known = grid.join(states, [USER, "domain", CHUNK], "left").withColumn(
        "__old", F.last("__state", ignorenulls=True).over(earlier)
    )
    return known.groupBy(USER, CHUNK).agg(
        *[F.first(F.when(F.col("domain") == d, F.col("__old")), ignorenulls=True).alias(f"__old_{d}") for d in domains]
    )


def with_histories(
    events: DataFrame, depths: Mapping[str, int], fields: Sequence[str], parts: int | None = None
) -> DataFrame:
    """``events`` with ``hist_<domain>``: structs of ``fields`` of earlier events, as many as ``depths`` says.

    ``events`` carries ``user_id``, ``event_ts``, ``event_id`` and ``domain``. With a
    depth not below what a layout reads, every feature equals the one from full histories.
    """
    event, domains, depth = F.struct(*fields), list(depths), max(depths.values())
    width = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = range_chunks(events, [USER, *ORDER], width)
    own = Window.partitionBy(USER, CHUNK, "domain").orderBy(*ORDER).rowsBetween(1 - depth, 0)
    before = Window.partitionBy(USER, CHUNK).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    within = (
        chunks.repartition(width, USER, CHUNK)
        .withColumn("__upto", F.collect_list(event).over(own))
        .select(
            *chunks.columns,
            *[
                F.last(F.when(F.col("domain") == d, F.col("__upto")), ignorenulls=True).over(before).alias(f"__new_{d}")
                for d in domains
            ],
        )
    )
    joined = within.join(_carried(chunks, event, domains, depth), [USER, CHUNK], "left")
    return joined.select(
        *events.columns,
        *[_newest(F.col(f"__old_{d}"), F.col(f"__new_{d}"), depths[d]).alias(f"hist_{d}") for d in domains],
    )
