"""Metrics, predictions and run histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from convfeat.catalog import sql as S
from convfeat.catalog.registry import query, rounded, sql_rounded
from convfeat.fixtures.samples import event_facts, samples, seconds, table
from convfeat.functions.scoring import sigmoid
from convfeat.operators import metrics as M
from convfeat.operators.predictions import last_per_user
from convfeat.operators.runs import early_stop, epoch_loss, first_improving_steps, select_checkpoints
from convfeat.operators.selection import label_of

SCORED_SQL = f"""{S.samples_sql()}, scored AS (
  SELECT sample_id, user_id, floor(value * 2 - 100 + 0.5::double) / 100 AS logit,
    CASE WHEN label_type = 2 THEN 1 ELSE 0 END AS label FROM samples)"""
SIGMOID = "1 / (1 + exp(-logit))"


def scored(spark, sf_dir):
    """Samples with a fixed scoring formula in place of a model."""
    return samples(spark, sf_dir).select(
        "sample_id",
        "user_id",
        (F.floor(F.col("value") * 2 - 100 + 0.5) / 100).alias("logit"),
        label_of(F.col("label_type")).alias("label"),
    )


@query(
    "auc",
    f"""WITH {SCORED_SQL}, counts AS (
  SELECT logit, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY logit),
ranked AS (SELECT *, sum(neg) OVER (ORDER BY logit) - neg / 2 AS below FROM counts)
SELECT {sql_rounded("sum(pos * below)::double / sum(pos)::double / sum(neg)::double")} AS auc FROM ranked""",
)
def auc(spark, sf_dir):
    """Exact area under the ROC curve."""
    df = scored(spark, sf_dir).withColumn("prob", sigmoid(F.col("logit")))
    return M.auc(df, "prob", "label").select(rounded(F.col("auc")).alias("auc"))


BCE = "(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))))"


@query("logloss", f"WITH {SCORED_SQL} SELECT {sql_rounded(f'avg({BCE})')} AS logloss FROM scored")
def logloss(spark, sf_dir):
    """Mean cross entropy."""
    return M.logloss(scored(spark, sf_dir), "logit", "label").select(rounded(F.col("logloss")).alias("logloss"))


FOCAL = (
    f"(CASE WHEN label = 1 THEN 0.1::double * pow(1 - {SIGMOID}, 2) ELSE 0.9::double * pow({SIGMOID}, 2) END * {BCE})"
)


@query(
    "focal_loss",
    f"""WITH {SCORED_SQL} SELECT 'mean' AS reduction, {sql_rounded(f"avg({FOCAL})")} AS focal_loss FROM scored
UNION ALL SELECT 'sum', {sql_rounded(f"sum({FOCAL})", 1000)} FROM scored""",
)
def focal_loss(spark, sf_dir):
    """Focal loss averaged and summed."""
    df = scored(spark, sf_dir)
    parts = []
    for reduction, scale in (("mean", 1_000_000), ("sum", 1000)):
        loss = M.focal_loss(df, "logit", "label", reduction=reduction)
        parts.append(loss.select(F.lit(reduction).alias("reduction"), rounded(F.col("focal_loss"), scale).alias("focal_loss")))
    return parts[0].unionByName(parts[1])


@query(
    "focal_rows",
    f"WITH {SCORED_SQL} SELECT sample_id, {sql_rounded(SIGMOID)} AS prob, {sql_rounded(FOCAL)} AS focal_loss FROM scored",
)
def focal_rows(spark, sf_dir):
    """Probability and focal loss of every sample."""
    df = M.focal_loss(scored(spark, sf_dir), "logit", "label", reduction="none")
    return df.select(
        "sample_id",
        rounded(sigmoid(F.col("logit"))).alias("prob"),
        rounded(F.col("focal_loss")).alias("focal_loss"),
    )


@query(
    "last_prediction",
    f"WITH {SCORED_SQL} SELECT user_id, {sql_rounded(f'max_by({SIGMOID}, sample_id)')} AS prob FROM scored GROUP BY user_id",
)
def last_prediction(spark, sf_dir):
    """One prediction per user: that of the last row in file order."""
    df = table(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        sigmoid(F.floor(F.col("value") * 2 - 100 + 0.5) / 100).alias("prob"),
        "_metadata.file_path",
        "_metadata.row_index",
    )
    kept = df.filter(F.col("event_type").isin("click", "purchase", "view"))
    return last_per_user(kept).select("user_id", rounded(F.col("prob")).alias("prob"))


# ---- run histories --------------------------------------------------------------

PATIENCE, DELTA, LAST = 5, 0.05, 40
PUBLISH = (1, 2, 4, 5, 6, 7)

RUNS_SQL = f"""{S.FACTS}, history AS (
  SELECT user_id AS run_id, event_id AS step, floor(value / 5 + 0.5::double) / 100 AS score,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS chk,
    count(*) OVER (PARTITION BY user_id) AS checks FROM facts)"""


def fold_sql(delta: float, last: int | None = None) -> str:
    """Recursive CTE ``fold``: the state of the patience counter after each check of each run."""
    ended = "f.waited >= %d" % PATIENCE + (f" OR f.chk >= {last}" if last else "")
    return f"""fold AS (
  SELECT run_id, chk, step, score, score AS best, chk AS best_chk, step AS best_step, 0 AS waited, true AS better
  FROM history WHERE chk = 1
  UNION ALL
  SELECT h.run_id, h.chk, h.step, h.score,
    CASE WHEN h.score > f.best + {delta}::double THEN h.score ELSE f.best END,
    CASE WHEN h.score > f.best + {delta}::double THEN h.chk ELSE f.best_chk END,
    CASE WHEN h.score > f.best + {delta}::double THEN h.step ELSE f.best_step END,
    CASE WHEN h.score > f.best + {delta}::double THEN 0 ELSE f.waited + 1 END,
    h.score > f.best + {delta}::double
  FROM fold f JOIN history h ON h.run_id = f.run_id AND h.chk = f.chk + 1 WHERE NOT ({ended})),
finals AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY chk DESC) = 1)"""


def histories(spark, sf_dir):
    """One run per user, one check per event."""
    return event_facts(spark, sf_dir).select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        (F.floor(F.col("value") / 5 + 0.5) / 100).alias("score"),
    )


def _early_stop_sql(delta: float) -> str:
    return f"""WITH RECURSIVE {RUNS_SQL}, {fold_sql(delta)}
SELECT run_id, best_chk AS best_check, best_step, best AS best_score,
  CASE WHEN waited >= {PATIENCE} THEN chk END AS stop_check, chk AS checks_run FROM finals"""


@query("early_stop", _early_stop_sql(0.0))
def early_stop_query(spark, sf_dir):
    """Best check and end of every run."""
    return early_stop(histories(spark, sf_dir), PATIENCE)


@query("early_stop_delta", _early_stop_sql(DELTA))
def early_stop_delta(spark, sf_dir):
    """The same with a least improvement."""
    return early_stop(histories(spark, sf_dir), PATIENCE, DELTA)


@query(
    "improving_steps",
    f'WITH RECURSIVE {RUNS_SQL}, {fold_sql(0.0)} SELECT run_id, chk AS "check", step, score FROM fold WHERE better',
)
def improving_steps(spark, sf_dir):
    """Checks at which a run stores a new best model."""
    return first_improving_steps(histories(spark, sf_dir), PATIENCE)


@query(
    "checkpoints",
    f"""WITH RECURSIVE {RUNS_SQL}, {fold_sql(0.0, LAST)}, chosen AS (
  SELECT run_id, CASE WHEN chk >= {LAST} THEN chk ELSE best_chk END AS c, 'best' AS kind FROM finals
  UNION ALL SELECT run_id, unnest([e for e in {list(PUBLISH)} if e <= chk]) AS c, 'publish' AS kind FROM finals)
SELECT chosen.run_id, c AS "check", kind, step, score FROM chosen JOIN history ON history.run_id = chosen.run_id AND chk = c""",
)
def checkpoints(spark, sf_dir):
    """Checkpoints left by runs of at most 40 epochs."""
    return select_checkpoints(histories(spark, sf_dir), PUBLISH, LAST, PATIENCE)


@query(
    "epoch_loss",
    f"""WITH {S.FACTS} SELECT user_id AS run_id, (sec - 1704067200) // 86400 + 1 AS epoch,
  {sql_rounded("avg(value)")} AS mean_loss FROM facts GROUP BY ALL""",
)
def epoch_loss_query(spark, sf_dir):
    """Average loss per run and epoch (here: user and day)."""
    losses = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        (F.floor((seconds() - 1704067200) / 86400) + 1).alias("epoch"),
        F.col("value").alias("loss"),
    )
    return epoch_loss(losses).withColumn("mean_loss", rounded(F.col("mean_loss")))
