"""Conversion of raw samples under a declared layout. Row-wise, so it also runs on a stream.

Every feature is its own expression: lists of several domains, hundreds of positions long,
never meet in one generated method.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.functions import arrays as A
from convfeat.functions import calendar as C
from convfeat.functions import dense as D
from convfeat.functions.ids import clean_id, clip_vocab, hash_item
from convfeat.layout import (
    EVENT_DAY_FID,
    EVENT_HOUR_FID,
    ITEM_HASH_FID,
    SAMPLE_CLOCK_FIDS,
    FeatureLayout,
    IdFeature,
    SequenceDomain,
)
from convfeat.operators.selection import label_of

log = logging.getLogger(__name__)


def project_layout(df: DataFrame, layout: FeatureLayout, keep: tuple[str, ...] = ()) -> DataFrame:
    """The declared input columns and nothing else, so the scan reads no others."""
    wanted = list(dict.fromkeys([*keep, *layout.input_columns()]))
    missing = [name for name in wanted if name not in df.columns and name != "label_type"]
    if missing:
        raise KeyError(f"columns declared by the layout are missing: {missing}")
    return df.select(*[name for name in wanted if name in df.columns])


def id_feature(side: str, feature: IdFeature, mode: str = "clip") -> str:
    """A cleaned, clipped id, or list of ``dim`` ids."""
    name = FeatureLayout.id_column(side, feature.fid)
    if feature.dim == 1:
        return clip_vocab(clean_id(name), feature.vocab, mode, name)
    return A.pad_ids(name, feature.dim, lambda x: clip_vocab(x, feature.vocab, mode, name))


def sequence_length(domain: SequenceDomain) -> str:
    """Longest side list after truncation; zeroed elements count, the time column does not."""
    lengths = [A.valid_length(domain.column(fid), domain.max_len) for fid, _ in domain.side_features]
    return f"greatest({', '.join([*lengths, '0'])})" if lengths else "0"


def sequence_pack(domain: SequenceDomain, mode: str = "clip") -> dict[str, str]:
    """Padded side lists ``<domain>_<fid>`` and ``<domain>_len``."""
    packed = {}
    for fid, vocab in domain.side_features:
        source = domain.column(fid)
        packed[f"{domain.name}_{fid}"] = A.pad_ids(
            source, domain.max_len, partial(clip_vocab, vocab=vocab, mode=mode, name=source)
        )
    return {**packed, f"{domain.name}_len": sequence_length(domain)}


def sequence_time_buckets(domain: SequenceDomain, sample_ts: str) -> str:
    """Gap bucket of every event; 0 on padding and in a domain without times."""
    if domain.ts_fid is None:
        return f"array_repeat(0L, {domain.max_len})"
    times = A.pad_raw(domain.column(domain.ts_fid), domain.max_len)
    return A.mapped(times, lambda t: C.time_bucket(sample_ts, t))


def sequence_hour_day(domain: SequenceDomain) -> tuple[str, str]:
    """Local hour and weekday of every event; 0 behind the valid length and for missing times."""
    if domain.ts_fid is None:
        empty = f"array_repeat(0L, {domain.max_len})"
        return empty, empty
    times = domain.column(domain.ts_fid)

    def on_valid(of: Callable[[str], str]) -> str:
        # The list of times cut to the valid length pads to zeros, and zeros stay zeros.
        valid = f"slice({times}, 1, {sequence_length(domain)})"
        return A.let(valid, lambda v: A.mapped(A.pad_raw(v, domain.max_len), of))

    return on_valid(C.event_hour), on_valid(C.event_day)


def feature_expressions(layout: FeatureLayout, mode: str = "clip") -> dict[str, str]:
    """Name -> SQL text of every feature of the layout over raw samples."""
    found: dict[str, str] = {}
    for feature in layout.user_ids:
        found[layout.id_column("user", feature.fid)] = id_feature("user", feature, mode)
    ts = "coalesce(timestamp, 0L)"
    if layout.sample_clock:
        for fid, value in zip(SAMPLE_CLOCK_FIDS, C.sample_clock(ts)):
            found[layout.id_column("user", fid)] = value
    for feature in layout.item_ids:
        found[layout.id_column("item", feature.fid)] = id_feature("item", feature, mode)
    if layout.item_buckets:
        found[layout.id_column("item", ITEM_HASH_FID)] = hash_item("item_id", layout.item_buckets)
    for feature in layout.user_dense:
        name = layout.dense_column(feature.fid)
        found[name] = A.pad_floats(name, feature.dim)
    for domain in layout.domains:
        found.update(sequence_pack(domain, mode))
        found[f"{domain.name}_time_bucket"] = sequence_time_buckets(domain, ts)
        if layout.event_clock:
            hours, days = sequence_hour_day(domain)
            found[f"{domain.name}_{EVENT_HOUR_FID}"] = hours
            found[f"{domain.name}_{EVENT_DAY_FID}"] = days
    return found


def convert(
    df: DataFrame,
    layout: FeatureLayout,
    training: bool = True,
    mode: str = "clip",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """All features of the layout in one projection; ``keep`` names columns passed through.

    Training rows need ``label_type``; others get label 0.
    """
    kept = [name for name in keep if name not in ("timestamp", "user_id", "label")]
    if training and "label_type" not in df.columns:
        raise KeyError("training rows need the column label_type")
    return df.select(
        *kept,
        "user_id",
        F.expr("coalesce(timestamp, 0L)").alias("timestamp"),
        label_of(F.col("label_type") if training else F.lit(None), training).alias("label"),
        *[F.expr(text).alias(name) for name, text in feature_expressions(layout, mode).items()],
    )


# ---- flat vectors and groups over converted samples ---------------------------


def as_list(layout: FeatureLayout, side: str, feature: IdFeature) -> str:
    column = layout.id_column(side, feature.fid)
    return column if feature.dim > 1 else f"array({column})"


def flat_vector(layout: FeatureLayout, side: str) -> str:
    """All features of ``user``, ``item`` or ``dense`` as one list at the layout's offsets."""
    if side == "dense":
        return A.joined([layout.dense_column(f.fid) for f in layout.user_dense])
    return A.joined([as_list(layout, side, f) for f in layout.side_features(side)])


def flatten_layout(df: DataFrame, layout: FeatureLayout, side: str, name: str) -> DataFrame:
    return df.withColumn(name, F.expr(flat_vector(layout, side)))


def group_vectors(layout: FeatureLayout, side: str) -> list[str]:
    """One list per feature group: the ids of its features in group order."""
    features = {f.fid: f for f in layout.side_features(side)}
    return [
        A.joined([as_list(layout, side, features[fid]) for fid in group])
        for group in layout.feature_groups(side)
    ]


def group_concat(df: DataFrame, layout: FeatureLayout, side: str) -> DataFrame:
    """Columns ``<side>_group_<n>`` added, numbered from 1."""
    vectors = group_vectors(layout, side)
    return df.select("*", *[F.expr(v).alias(f"{side}_group_{i}") for i, v in enumerate(vectors, 1)])


def dense_groups(
    df: DataFrame,
    layout: FeatureLayout,
    embedding: tuple[int, ...],
    statistic: tuple[int, ...],
    trend: tuple[int, ...],
    log_top: float = 20.0,
) -> DataFrame:
    """Dense features regrouped by meaning, each group scaled its own way.

    Adds ``dense_embedding`` (unit length per feature), ``dense_statistic`` (clamped log) and
    ``dense_trend`` (equal-length segments). Absent features are skipped; an empty group is a
    single zero.
    """
    declared = {f.fid: f for f in layout.user_dense if f.dim > 0}

    def present(fids: tuple[int, ...], group: str) -> list[int]:
        absent = [fid for fid in fids if fid not in declared]
        if absent:
            log.warning("dense group %s skips absent features %s", group, absent)
        return [fid for fid in fids if fid in declared]

    units = [D.l2_normalize(layout.dense_column(fid)) for fid in present(embedding, "embedding")]
    logs = [D.log_clamp(layout.dense_column(fid), log_top) for fid in present(statistic, "statistic")]
    shapes = present(trend, "trend")
    stacked = "array(array(0D))"
    if shapes:
        lengths = [declared[fid].dim for fid in shapes]
        stacked = A.stack_segments(A.joined([layout.dense_column(fid) for fid in shapes]), lengths)
    return df.select(
        "*",
        F.expr(A.joined(units) if units else "array(0D)").alias("dense_embedding"),
        F.expr(A.joined(logs) if logs else "array(0D)").alias("dense_statistic"),
        F.expr(stacked).alias("dense_trend"),
    )
