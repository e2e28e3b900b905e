"""Checkpoint selection over the metric history of training runs.

A history has one row per check: ``run_id``, ``step`` (increasing within the run), ``score``.
Runs of any length are cut into ranges of rows; between ranges only the best score and the
number of checks so far are passed on. A score that is not a number is a check that never improves;
as a run's first score it stays the best.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convfeat.operators.distribution import CHUNK, range_chunks
from convfeat.session import cut

RUN = "run_id"


def _numbered(history: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``check`` from 1 and the best earlier score, number of checks per run)."""
    chunks = range_chunks(history.select(RUN, "step", "score"), [RUN, "step"], parts)
    number = F.when(~F.isnan("score"), F.col("score"))
    pieces = chunks.groupBy(RUN, CHUNK).agg(
        F.max(number).alias("top"), F.count("*").alias("n"), F.min_by("score", "step").alias("head")
    )
    earlier = Window.partitionBy(RUN).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        RUN,
        CHUNK,
        F.max("top").over(earlier).alias("__top"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"),
        F.isnan(F.first("head").over(Window.partitionBy(RUN).orderBy(CHUNK))).alias("__stuck"),
    )
    inside = Window.partitionBy(RUN, CHUNK).orderBy("step")
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    check = F.col("__n") + F.row_number().over(inside)
    numbered = chunks.join(carried, [RUN, CHUNK]).withColumns(
        {"check": check, "__best": F.greatest("__top", F.max(number).over(above))}
    )
    best = F.when(F.col("__stuck") & (F.col("check") > 1), F.lit(float("nan"))).otherwise(F.col("__best"))
    rows = numbered.select(RUN, "step", "score", "check", best.alias("best_before"))
    return rows, pieces.groupBy(RUN).agg(F.sum("n").alias("checks"))


def _successors(maxima: DataFrame, delta: float, parts: int | None) -> DataFrame:
    """Per new maximum: ``next``, the first later maximum of its run above its score plus ``delta``.

    An as-of lookup in sorted ranges: each maximum is a data row at its score and a probe at its
    score plus ``delta``; data at the probe's own key sorts first and does not count (strictly
    above). Within a range the next data row follows from a window; across ranges one summary
    row per range and run carries the first data row onwards.
    """
    data = maxima.select(RUN, F.col("score").alias("key"), F.lit(0).alias("kind"), "check")
    probes = maxima.select(RUN, (F.col("score") + F.lit(delta)).alias("key"), F.lit(1).alias("kind"), "check")
    chunks = range_chunks(data.unionByName(probes), [RUN, "key", "kind", "check"], parts)
    found = F.when(F.col("kind") == 0, F.col("check"))
    later = Window.partitionBy(CHUNK, RUN).orderBy("key", "kind", "check").rowsBetween(1, Window.unboundedFollowing)
    inside = chunks.withColumn("__inside", F.min(found).over(later))
    firsts = chunks.groupBy(RUN, CHUNK).agg(F.min(found).alias("__first"))
    onwards = Window.partitionBy(RUN).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select(RUN, CHUNK, F.min("__first").over(onwards).alias("__carried"))
    probed = inside.where(F.col("kind") == 1).join(carried, [RUN, CHUNK])
    return probed.select(RUN, "check", F.coalesce("__inside", "__carried").alias("next"))


def _chain(maxima: DataFrame, delta: float, parts: int | None) -> DataFrame:
    """Maxima that beat the last kept one by more than ``delta``, the first of a run always kept.

    The kept checks are the chain head, next(head), next(next(head)), ... Pointer doubling builds
    next^(2^i) by joins on (run, check), then the chain grows from the heads level by level; no
    run passes through one task and no Python runs.
    """
    jumps = [cut(_successors(maxima, delta, parts))]
    longest = jumps[0].groupBy(RUN).count().agg(F.max("count")).first()[0] or 0
    while (1 << len(jumps)) <= longest:
        last = jumps[-1]
        twice = last.alias("a").join(last.alias("b"), (F.col(f"a.{RUN}") == F.col(f"b.{RUN}")) & (F.col("a.next") == F.col("b.check")))
        jumps.append(cut(twice.select(F.col(f"a.{RUN}").alias(RUN), F.col("a.check").alias("check"), F.col("b.next").alias("next"))))
    chain = maxima.groupBy(RUN).agg(F.min("check").alias("check"))
    for jump in jumps:
        reached = chain.join(jump, [RUN, "check"]).where(F.col("next").isNotNull()).select(RUN, F.col("next").alias("check"))
        chain = cut(chain.unionByName(reached).distinct())
    return maxima.join(chain, [RUN, "check"])


def _improvements(rows: DataFrame, delta: float, parts: int | None = None) -> DataFrame:
    """Checks that improved on the best kept score by more than ``delta``.

    Only a new maximum can (a kept score is never below an earlier maximum), so all other rows
    are gone before the chain of kept maxima is followed.
    """
    above = ~F.isnan("score") & (F.col("score") > F.col("best_before"))
    maxima = rows.filter(F.col("best_before").isNull() | above)
    maxima = maxima.select(RUN, "step", "score", "check")
    if delta == 0:
        return maxima
    return _chain(maxima, delta, parts)


def _judged(
    history: DataFrame, patience: int, delta: float, parts: int | None, last: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, improvements with ``stop``: the check at which waiting ends, if it does)."""
    rows, sizes = _numbered(history, parts)
    if last is not None:
        rows = rows.filter(F.col("check") <= last)
        sizes = sizes.withColumn("checks", F.least("checks", F.lit(last).cast("long")))
    following = F.lead("check").over(Window.partitionBy(RUN).orderBy("check"))
    gap = F.coalesce(following, F.col("checks") + 1) - F.col("check")
    better = _improvements(rows, delta, parts).join(sizes, RUN)
    return rows, better.withColumn("stop", F.when(gap > patience, F.col("check") + patience))


def _ended(better: DataFrame) -> DataFrame:
    ended = better.groupBy(RUN).agg(
        F.min("stop").alias("stop_check"),
        F.max("checks").alias("checks"),
        F.min_by(F.struct("check", "step", "score"), F.col("stop")).alias("at_stop"),
        F.max_by(F.struct("check", "step", "score"), F.col("check")).alias("at_end"),
    )
    best = F.when(F.col("stop_check").isNull(), F.col("at_end")).otherwise(F.col("at_stop"))
    return ended.select(
        RUN,
        best["check"].alias("best_check"),
        best["step"].alias("best_step"),
        best["score"].alias("best_score"),
        "stop_check",
        F.coalesce("stop_check", "checks").alias("checks_run"),
    )


def early_stop(
    history: DataFrame, patience: int = 5, delta: float = 0.0, parts: int | None = None
) -> DataFrame:
    """Per run: best check, its step and score, and the check at which training stops (or null)."""
    return _ended(_judged(history, patience, delta, parts)[1])


def first_improving_steps(
    history: DataFrame, patience: int = 5, delta: float = 0.0, parts: int | None = None
) -> DataFrame:
    """The checks, up to the stop, at which a new best model is stored."""
    _, better = _judged(history, patience, delta, parts)
    stops = better.groupBy(RUN).agg(F.min("stop").alias("__stop"))
    reached = F.col("__stop").isNull() | (F.col("check") <= F.col("__stop"))
    return better.join(stops, RUN).filter(reached).select(RUN, "check", "step", "score")


def select_checkpoints(
    history: DataFrame,
    publish: Sequence[int],
    last: int,
    patience: int = 5,
    delta: float = 0.0,
    parts: int | None = None,
) -> DataFrame:
    """Checkpoints a run leaves behind, one check per epoch: ``best`` and the published epochs.

    A run that reaches epoch ``last`` ends there, and that epoch is its best by decree.
    """
    rows, better = _judged(history, patience, delta, parts, last)
    result = _ended(better)
    final = F.when(F.col("checks_run") >= last, F.lit(last).cast("long")).otherwise(F.col("best_check"))
    best = result.select(RUN, final.alias("check"), F.lit("best").alias("kind"))
    epochs = F.array(*[F.lit(e).cast("long") for e in sorted(set(publish))])
    listed = result.select(
        RUN,
        F.explode(F.filter(epochs, lambda e: e <= F.col("checks_run"))).alias("check"),
        F.lit("publish").alias("kind"),
    )
    return best.unionByName(listed).join(rows.select(RUN, "check", "step", "score"), [RUN, "check"])


def epoch_loss(losses: DataFrame) -> DataFrame:
    """Average loss per run and epoch."""
    return losses.groupBy(RUN, "epoch").agg(F.avg("loss").alias("mean_loss"))
