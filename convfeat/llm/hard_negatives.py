"""Hard-negative mining with LEMP-style coordinate pruning.

Every usable row is an integer vector x = floor(256 * c) with a label; anchors are rows whose vec_id
is divisible by 100. A row's score against an anchor is the exact integer inner product; higher
scores come first, ties go to the smaller vec_id. An anchor's positives are its five best other rows
of the same label; for each positive with score s, its negatives are the five best rows of another
label whose score n satisfies 80 s <= 100 n <= 100 s.

Anchors and all rows meet in blocks: anchors in blocks of ``ANCHOR_BLOCK``, rows in blocks of
about ``ROW_BLOCK``, and each pair of blocks is one group of a cogroup (a stated query set against
all rows, in blocks). Inside a group the rows are sorted by length into buckets of ``BUCKET``
rows; each bucket keeps, for every dimension, the sorted list of its rows' normalised coordinates.
For a threshold t > 0 on the inner product, a bucket whose longest row has length L is skipped
when |q| L < t; otherwise a row can only reach t if its normalised coordinate on each of the
anchor's ``FOCUS`` largest dimensions f lies in q_f t_b -+ sqrt((1 - q_f^2)(1 - t_b^2)) with
t_b = t / (|q| L), the interval open to 1 when q_f > t_b and to -1 when q_f < -t_b. The candidates found by binary search in those lists are intersected and then
verified exactly. Positives are searched with the running fifth-best score as threshold;
negatives with 0.8 times the smallest positive score. Partial answers of the blocks, at most five
per anchor (and positive), are merged by a window on the anchor.

Cases: rows with a null vec_id, label or vector, or a null, NaN or infinite entry, take no part;
shorter vectors count as filled with zeros. Repeated rows are separate rows (an anchor does not
meet its own row, but meets its copies); ties of score and vec_id go by an internal row number.
A positive of negative score has no negatives; one of score 0 only those of score 0. An anchor
with no other row of its label has no positives and no output. Extra columns are ignored. An
empty table gives an empty result. Entries beyond +-2^26 are verified with Python integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convfeat.llm.common import written
from convfeat.llm.whitening import valid_rows

ANCHOR_BLOCK = 1024
ROW_BLOCK = 8192
BUCKET = 256
FOCUS = 3
TOP = 5
#: Slack on normalised coordinates: above the square root of the rounding of 1 - local^2; candidates are verified exactly.
SLACK = 1e-7
EXACT_LIMIT = 1 << 26


class Index:
    """Rows of one block sorted by length into buckets, each with sorted coordinate lists."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rids: np.ndarray, bucket: int = BUCKET):
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((rids, -norms))
        self.x, self.ids, self.labels, self.rids, self.norms = x[order], ids[order], labels[order], rids[order], norms[order]
        self.exact = x.size == 0 or (-EXACT_LIMIT <= int(x.min()) and int(x.max()) <= EXACT_LIMIT)
        self.buckets = []
        for start in range(0, len(order), bucket):
            end = min(start + bucket, len(order))
            block = self.x[start:end].astype(np.float64)
            length = self.norms[start]
            unit = block / np.where(self.norms[start:end] > 0, self.norms[start:end], 1.0)[:, None]
            sorting = np.argsort(unit, axis=0, kind="stable")
            values = np.take_along_axis(unit, sorting, axis=0)
            self.buckets.append((start, end, length, sorting, values))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact and (q.size == 0 or -EXACT_LIMIT <= int(q.min()) and int(q.max()) <= EXACT_LIMIT):
            return self.x[rows] @ q
        return np.array([sum(int(a) * int(b) for a, b in zip(self.x[r], q)) for r in rows], dtype=object)

    def _query(self, q: np.ndarray):
        qnorm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS] if qnorm > 0 else []
        return qnorm, focus, (q.astype(np.float64) / qnorm if qnorm > 0 else q.astype(np.float64))

    @staticmethod
    def _in_bucket(bucket, query, threshold: float | None) -> np.ndarray | None:
        """Rows of one bucket that may reach ``threshold``; None when no row of it or of a shorter bucket can."""
        start, end, length, sorting, values = bucket
        qnorm, focus, qbar = query
        if threshold is None or threshold <= 0:
            return np.arange(start, end)
        reach, threshold = qnorm * length, threshold * (1 - 1e-12)
        if reach < threshold:
            return None
        local = min(threshold / reach, 1.0)
        found = None
        for f in focus:
            # angle to the axis within the threshold angle of the anchor's: cos(a + g) <= p_f <= cos(a - g),
            # reaching 1 when a < g and -1 when a + g > pi
            centre, spread = qbar[f] * local, math.sqrt(max((1 - qbar[f] ** 2) * (1 - local**2), 0.0))
            low = -math.inf if qbar[f] < -local else centre - spread - SLACK
            high = math.inf if qbar[f] > local else centre + spread + SLACK
            lo = np.searchsorted(values[:, f], low, "left")
            hi = np.searchsorted(values[:, f], high, "right")
            rows = sorting[lo:hi, f]
            found = rows if found is None else np.intersect1d(found, rows, assume_unique=True)
            if not len(found):
                break
        return np.arange(start, end) if found is None else np.sort(found) + start

    def candidates(self, q: np.ndarray, threshold: float | None):
        """Row positions, bucket by bucket, that may reach ``threshold`` (all rows without one)."""
        query = self._query(q)
        for bucket in self.buckets:
            rows = self._in_bucket(bucket, query, threshold)
            if rows is None:
                return  # buckets are in falling length: none after this one reaches it either
            yield rows

    def best(self, q: np.ndarray, keep, threshold_of, top: int = TOP) -> list[tuple]:
        """The ``top`` best rows (score, vec_id, rid) that ``keep`` admits; ``threshold_of(best so far)`` prunes."""
        query, chosen = self._query(q), []
        for bucket in self.buckets:
            rows = self._in_bucket(bucket, query, threshold_of(chosen))
            if rows is None:
                break
            rows = rows[keep(rows)]
            if not len(rows):
                continue
            got = self.scores(rows, q)
            chosen.extend((int(s), int(self.ids[r]), int(self.rids[r])) for s, r in zip(got, rows))
            chosen.sort(key=lambda t: (-t[0], t[1], t[2]))
            del chosen[top:]
        return chosen


def _vectors(frame: pd.DataFrame, width: int) -> np.ndarray:
    out = np.zeros((len(frame), width), np.int64)
    for i, v in enumerate(frame["x"]):
        out[i, : len(v)] = np.asarray(v, np.int64)
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """rid, vec_id, label (moved on for vec_id divisible by 7), x; only whole, finite, labelled rows."""
    labelled = embeddings.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    moved = labelled.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.cast("long").alias("label"))
    return valid_rows(moved, "label").withColumn("rid", F.monotonically_increasing_id())


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, sizes: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Anchors repeated for every row block, rows for every anchor block."""
    blocks, anchor_blocks = max(math.ceil(n_rows / sizes[1]), 1), max(math.ceil(n_anchors / sizes[0]), 1)
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # own column ids: both sides come from ``rows``
    # cogroup does not coerce its keys: an int and a long of one value hash to different partitions
    left = anchors.withColumn("ablock", F.pmod(F.xxhash64("rid"), F.lit(anchor_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("ablock", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    return left, right


POSITIVE = "anchor_rid long, anchor_id long, label long, positive_rid long, positive_id long, positive_score long"
NEGATIVE = "anchor_rid long, anchor_id long, positive_rid long, positive_id long, positive_score long, negative_rid long, negative_id long, negative_score long"


def _positives(width: int, bucket: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            index = Index(_vectors(rows, width), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["rid"].to_numpy(), bucket)
            qs = _vectors(anchors, width)
            for q, a_rid, a_id, label in zip(qs, anchors["rid"], anchors["vec_id"], anchors["label"]):
                keep = lambda r, label=label, a_rid=a_rid: (index.labels[r] == label) & (index.rids[r] != a_rid)
                fifth = lambda chosen: chosen[-1][0] - 0.5 if len(chosen) == TOP else None
                for score, vid, rid in index.best(q, keep, fifth):
                    out.append((int(a_rid), int(a_id), int(label), rid, vid, score))
        return pd.DataFrame(out, columns=["anchor_rid", "anchor_id", "label", "positive_rid", "positive_id", "positive_score"])

    return run


def _negatives(width: int, bucket: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            index = Index(_vectors(rows, width), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["rid"].to_numpy(), bucket)
            qs = _vectors(anchors, width)
            for q, a_rid, a_id, label, positives in zip(qs, anchors["rid"], anchors["vec_id"], anchors["label"], anchors["positives"]):
                scores = [int(p["positive_score"]) for p in positives if int(p["positive_score"]) >= 0]
                if not scores:
                    continue
                floor = 0.8 * min(scores)
                every = []
                for rows_at in index.candidates(q, floor - 0.5 if floor > 0 else None):
                    rows_at = rows_at[index.labels[rows_at] != label]
                    got = index.scores(rows_at, q)
                    every.extend((int(s), int(index.ids[r]), int(index.rids[r])) for s, r in zip(got, rows_at) if 80 * min(scores) <= 100 * int(s))
                every.sort(key=lambda t: (-t[0], t[1], t[2]))
                for p in positives:
                    s = int(p["positive_score"])
                    if s < 0:
                        continue
                    picked = [t for t in every if 80 * s <= 100 * t[0] <= 100 * s][:TOP]
                    out.extend((int(a_rid), int(a_id), int(p["positive_rid"]), int(p["positive_id"]), s, t[2], t[1], t[0]) for t in picked)
        return pd.DataFrame(out, columns=["anchor_rid", "anchor_id", "positive_rid", "positive_id", "positive_score", "negative_rid", "negative_id", "negative_score"])

    return run


def hard_negatives(embeddings: DataFrame, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, bucket: int = BUCKET) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (see the module)."""
    spark = embeddings.sparkSession
    rows = written(usable(embeddings), "negatives-rows")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % 100 == 0).cast("long")).alias("a"), F.max(F.size("x")).alias("w")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not counts["n"] or not counts["a"]:
        return spark.createDataFrame([], schema)
    width = int(counts["w"] or 0)
    anchors = rows.where(F.col("vec_id") % 100 == 0)
    left, right = _grid(rows, anchors, counts["n"], counts["a"], (anchor_block, row_block))
    partial = left.groupBy("ablock", "block").cogroup(right.groupBy("ablock", "block")).applyInPandas(_positives(width, bucket), POSITIVE)
    order = Window.partitionBy("anchor_rid").orderBy(F.desc("positive_score"), "positive_id", "positive_rid")
    positives = written(partial.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TOP).drop("k"), "negatives-positives")
    carried = positives.groupBy("anchor_rid").agg(F.collect_list(F.struct("positive_rid", "positive_id", "positive_score")).alias("positives"))
    anchors = anchors.join(carried.withColumnRenamed("anchor_rid", "rid"), "rid")
    left, right = _grid(rows, anchors, counts["n"], counts["a"], (anchor_block, row_block))
    partial = left.groupBy("ablock", "block").cogroup(right.groupBy("ablock", "block")).applyInPandas(_negatives(width, bucket), NEGATIVE)
    order = Window.partitionBy("anchor_rid", "positive_rid").orderBy(F.desc("negative_score"), "negative_id", "negative_rid")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
