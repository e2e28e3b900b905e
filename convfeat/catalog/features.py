"""Id features, padded lists, sequences and dense groups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from convfeat.catalog import sql as S
from convfeat.catalog.registry import ids_text, query, sql_ids, sql_vec, vec_text
from convfeat.fixtures.samples import LAYOUT, event_facts, samples, table
from convfeat.functions import arrays as A
from convfeat.functions import dense as D
from convfeat.functions.ids import hash_item, hash_seq, route_feature, routed_id
from convfeat.layout import EVENT_DAY_FID, EVENT_HOUR_FID
from convfeat.operators.features import convert, dense_groups, flat_vector, group_concat
from convfeat.operators.oob import oob_stats
from convfeat.plans.inputs import DENSE_GROUPS

USER_CLIPPED = ", ".join(
    [
        f"{S.clip('user_int_feats_1', 20)} AS user_int_feats_1",
        f"{S.clip('user_int_feats_15', 6)} AS user_int_feats_15",
        "0::bigint AS user_int_feats_48",
        f"{S.pad('user_int_feats_60', 5, 150)} AS user_int_feats_60",
    ]
)
ITEM_CLIPPED = ", ".join(
    [
        f"{S.clip('item_int_feats_5', 51)} AS item_int_feats_5",
        f"{S.clip('item_int_feats_11', 20)} AS item_int_feats_11",
        f"{S.pad('item_int_feats_16', 4, 60)} AS item_int_feats_16",
        "CASE WHEN item_id > 0 THEN (item_id - 1) % 40 + 1 ELSE 0 END::bigint AS item_hash",
    ]
)
CLOCK = (
    f"{S.hour('timestamp')} AS h, {S.day('timestamp')} AS d, "
    f"CASE WHEN {S.day('timestamp')} >= 6 THEN 2 ELSE 1 END::bigint AS w, ({S.hour('timestamp')} - 1) // 6 + 1 AS p"
)


def converted(spark, sf_dir, *parts):
    """The derived samples under the layout restricted to the asked parts."""
    layout = LAYOUT
    if "user" not in parts:
        layout = replace(layout, user_ids=())
    if "item" not in parts:
        layout = replace(layout, item_ids=())
    if "dense" not in parts:
        layout = replace(layout, user_dense=())
    if "seq" not in parts:
        layout = replace(layout, domains=())
    return convert(samples(spark, sf_dir, parts), layout, keep=("sample_id",))


@query(
    "clean_clip_ids",
    f"""WITH {S.samples_sql("user", "item")}, c AS (SELECT sample_id, {USER_CLIPPED}, {ITEM_CLIPPED} FROM samples)
SELECT sample_id, user_int_feats_1, user_int_feats_15, user_int_feats_48,
  {sql_ids("user_int_feats_60")} AS user_int_feats_60, item_int_feats_5, item_int_feats_11,
  {sql_ids("item_int_feats_16")} AS item_int_feats_16 FROM c""",
)
def clean_clip_ids(spark, sf_dir):
    """Cleaned and vocabulary-clipped id features of both sides."""
    return converted(spark, sf_dir, "user", "item").select(
        "sample_id",
        "user_int_feats_1",
        "user_int_feats_15",
        "user_int_feats_48",
        ids_text("user_int_feats_60").alias("user_int_feats_60"),
        "item_int_feats_5",
        "item_int_feats_11",
        ids_text("item_int_feats_16").alias("item_int_feats_16"),
    )


_SCANNED = [
    ("user_int", 1, 20, f"[{S.clean('user_int_feats_1')}]"),
    ("user_int", 15, 6, f"[{S.clean('user_int_feats_15')}]"),
    ("user_int", 60, 150, S.pad("user_int_feats_60", 5)),
    ("item_int", 5, 51, f"[{S.clean('item_int_feats_5')}]"),
    ("item_int", 11, 20, f"[{S.clean('item_int_feats_11')}]"),
    ("item_int", 16, 60, S.pad("item_int_feats_16", 4)),
    ("seq_a", 101, 90, S.pad("seq_a_101", 8)),
    ("seq_b", 102, 100, S.pad("seq_b_102", 8)),
    ("seq_b", 69, 2_000_000, S.pad("seq_b_69", 8)),
    ("seq_c", 103, 100, S.pad("seq_c_103", 16)),
    ("seq_c", 34, 1_500_000, S.pad("seq_c_34", 16)),
]


@query(
    "oob_report",
    f"WITH {S.samples_sql('user', 'item', 'seq')}, ids AS ("
    + " UNION ALL ".join(
        f"SELECT '{group}' AS feature_group, {fid}::bigint AS fid, {vocab}::bigint AS vocab, unnest({e}) AS id FROM samples"
        for group, fid, vocab, e in _SCANNED
    )
    + """)
SELECT feature_group, fid, vocab, count(*) AS oob_count, min(id)::bigint AS oob_min, max(id)::bigint AS oob_max
FROM ids WHERE id >= vocab GROUP BY ALL""",
)
def oob_report(spark, sf_dir):
    """Out-of-vocabulary statistics of all id features, in one aggregation."""
    return oob_stats(samples(spark, sf_dir, ("user", "item", "seq")), LAYOUT)


@query(
    "item_hash",
    f"""WITH {S.samples_sql()} SELECT sample_id, item_id,
  CASE WHEN item_id > 0 THEN (item_id - 1) % 7 + 1 ELSE 0 END::bigint AS small_hash,
  CASE WHEN item_id > 0 THEN (item_id - 1) % 50000 + 1 ELSE 0 END::bigint AS full_hash FROM samples""",
)
def item_hash(spark, sf_dir):
    """Item ids hashed into 7 and into the default number of buckets."""
    return samples(spark, sf_dir).selectExpr(
        "sample_id", "item_id", f"{hash_item('item_id', 7)} AS small_hash", f"{hash_item('item_id')} AS full_hash"
    )


@query(
    "seq_hash",
    f"""WITH {S.samples_sql("seq")} SELECT sample_id,
  {sql_ids(f"list_transform({S.pad('seq_b_69', 8)}, lambda x: CASE WHEN x > 0 THEN x % 500 + 1 ELSE 0 END)")} AS hashed_69
FROM samples""",
)
def seq_hash(spark, sf_dir):
    """Ids of a large sequence feature hashed into 500 buckets."""
    ids = converted(spark, sf_dir, "seq").select("sample_id", "seq_b_69")
    hashed = A.mapped("seq_b_69", lambda x: hash_seq(x, 500))
    return ids.select("sample_id", ids_text(hashed).alias("hashed_69"))


ALLOWED = {"seq_b": {69}, "seq_c": {29}}


@query(
    "routed_ids",
    f"""WITH {S.FACTS} SELECT event_id, k AS seq_a_101, (event_id + 1) % 500 + 1 AS seq_b_69,
  0::bigint AS seq_c_34, 0::bigint AS seq_d_104 FROM facts""",
)
def routed_ids(spark, sf_dir):
    """Lookup keys by route: own table, hash table, or none for large and for unsized features."""
    raw = {"seq_a_101": "k", "seq_b_69": "(event_id + 1)", "seq_c_34": "cents", "seq_d_104": "k"}
    columns = []
    for domain in LAYOUT.domains:
        for fid, vocab in domain.side_features:
            name = f"{domain.name}_{fid}"
            if name in raw:
                route = route_feature(domain.name, fid, vocab, 1_000_000, 500, ALLOWED)
                columns.append(f"{routed_id(raw[name], route, 500)} AS {name}")
    return event_facts(spark, sf_dir).selectExpr("event_id", *columns)


# ---- lists ------------------------------------------------------------------------


@query(
    "pad_ids",
    f"""WITH {S.samples_sql("user", "item")} SELECT sample_id, {sql_ids(S.pad("user_int_feats_60", 5))} AS orders_5,
  {S.size("user_int_feats_60", 5)}::int AS orders_len, {sql_ids(S.pad("item_int_feats_16", 5))} AS item_5,
  {S.size("item_int_feats_16", 5)}::int AS item_len FROM samples""",
)
def pad_ids(spark, sf_dir):
    """Lists cut or filled to five ids, and their lengths."""
    orders, item = "user_int_feats_60", "item_int_feats_16"
    return samples(spark, sf_dir, ("user", "item")).select(
        "sample_id",
        ids_text(A.pad_ids(orders, 5)).alias("orders_5"),
        F.expr(A.valid_length(orders, 5)).alias("orders_len"),
        ids_text(A.pad_ids(item, 5)).alias("item_5"),
        F.expr(A.valid_length(item, 5)).alias("item_len"),
    )


@query(
    "pad_floats",
    f"""WITH {S.samples_sql("dense")} SELECT sample_id, {sql_vec(S.pad_floats("user_dense_feats_62", 8), 100)} AS totals_8,
  {sql_vec(S.pad_floats("user_dense_feats_89", 6))} AS ratios_6 FROM samples""",
)
def pad_floats(spark, sf_dir):
    """Dense lists cut or filled to their declared width."""
    return samples(spark, sf_dir, ("dense",)).select(
        "sample_id",
        vec_text(A.pad_floats("user_dense_feats_62", 8), 100).alias("totals_8"),
        vec_text(A.pad_floats("user_dense_feats_89", 6)).alias("ratios_6"),
    )


def _pack_sql(domain) -> str:
    return ", ".join(
        [f"{S.pad(f'{domain.name}_{fid}', domain.max_len, vocab)} AS p_{domain.name}_{fid}"
         if vocab else f"list_resize([]::bigint[], {domain.max_len}, 0) AS p_{domain.name}_{fid}"
         for fid, vocab in domain.side_features]
        + [f"{S.size(f'{domain.name}_{domain.side_features[0][0]}', domain.max_len)}::int AS {domain.name}_len"]
    )


PACKED = ", ".join(_pack_sql(d) for d in LAYOUT.domains)
PACKED_NAMES = [f"{d.name}_{fid}" for d in LAYOUT.domains for fid, _ in d.side_features]
LENGTHS = [f"{d.name}_len" for d in LAYOUT.domains]


@query(
    "seq_pack",
    f"""WITH {S.samples_sql("seq")}, p AS (SELECT sample_id, {PACKED} FROM samples)
SELECT sample_id, {", ".join(f"{sql_ids('p_' + n)} AS {n}" for n in PACKED_NAMES)}, {", ".join(LENGTHS)} FROM p""",
)
def seq_pack(spark, sf_dir):
    """Side lists of all four domains, padded and clipped, with the sequence lengths."""
    packed = converted(spark, sf_dir, "seq")
    return packed.select("sample_id", *[ids_text(n).alias(n) for n in PACKED_NAMES], *LENGTHS)


TIMED = [d for d in LAYOUT.domains if d.ts_fid is not None]


def _times(d) -> str:
    return f"list_resize(coalesce({d.name}_{d.ts_fid}, [])[1:{d.max_len}], {d.max_len}, 0)"


@query(
    "seq_time_bucket",
    f"WITH {S.samples_sql('seq')} SELECT sample_id, "
    + ", ".join(
        sql_ids(f"list_transform({_times(d)}, lambda t: {S.bucket('timestamp', 't')})") + f" AS {d.name}_time_bucket"
        for d in TIMED
    )
    + f", {sql_ids('list_resize([]::bigint[], 16, 0)')} AS seq_d_time_bucket FROM samples",
)
def seq_time_bucket(spark, sf_dir):
    """Gap bucket of every event of every domain."""
    names = [f"{d.name}_time_bucket" for d in LAYOUT.domains]
    return converted(spark, sf_dir, "seq").select("sample_id", *[ids_text(n).alias(n) for n in names])


@query(
    "seq_hour_day",
    f"WITH {S.samples_sql('seq')} SELECT sample_id, "
    + ", ".join(
        sql_ids(f"list_transform({_times(d)}, lambda t: CASE WHEN t > 0 THEN {fn('t')} ELSE 0 END)") + f" AS {d.name}_{part}"
        for d in TIMED
        for part, fn in (("hour", S.hour), ("day", S.day))
    )
    + " FROM samples",
)
def seq_hour_day(spark, sf_dir):
    """Local hour and weekday of every event."""
    df = converted(spark, sf_dir, "seq")
    columns = []
    for d in TIMED:
        columns.append(ids_text(f"{d.name}_{EVENT_HOUR_FID}").alias(f"{d.name}_hour"))
        columns.append(ids_text(f"{d.name}_{EVENT_DAY_FID}").alias(f"{d.name}_day"))
    return df.select("sample_id", *columns)


@query(
    "padding_mask",
    f"""WITH {S.samples_sql("seq")} SELECT sample_id,
  array_to_string(list_transform(range(8), lambda i: CASE WHEN i >= {S.size("seq_a_101", 8)} THEN 1 ELSE 0 END), ',') AS mask_a,
  array_to_string(list_transform(range(16), lambda i: CASE WHEN i >= {S.size("seq_c_103", 16)} THEN 1 ELSE 0 END), ',') AS mask_c
FROM samples""",
)
def padding_mask(spark, sf_dir):
    """Which positions of two domains are padding."""
    df = converted(spark, sf_dir, "seq")

    def flags(length, n):
        return ids_text(A.mapped(A.padding_mask(length, n), lambda b: f"int({b})"))

    return df.select("sample_id", flags("seq_a_len", 8).alias("mask_a"), flags("seq_c_len", 16).alias("mask_c"))


@query(
    "latest_k",
    f"""WITH {S.samples_sql("seq")}, p AS (SELECT sample_id, {PACKED} FROM samples)
SELECT sample_id, {sql_ids("p_seq_a_101[greatest(seq_a_len - 3, 0) + 1 : seq_a_len]")} AS last_views,
  {sql_ids("p_seq_c_103[greatest(seq_c_len - 4, 0) + 1 : seq_c_len]")} AS last_purchases FROM p""",
)
def latest_k(spark, sf_dir):
    """Last valid elements of a packed sequence."""
    df = converted(spark, sf_dir, "seq")
    return df.select(
        "sample_id",
        ids_text(A.latest_k("seq_a_101", "seq_a_len", 3)).alias("last_views"),
        ids_text(A.latest_k("seq_c_103", "seq_c_len", 4)).alias("last_purchases"),
    )


# ---- flat vectors and groups --------------------------------------------------------

FLAT_USER = "list_concat(list_concat([user_int_feats_1, user_int_feats_15, user_int_feats_48], user_int_feats_60), [h, d, w, p])"
FLAT_ITEM = "list_concat(list_concat([item_int_feats_5, item_int_feats_11], item_int_feats_16), [item_hash])"
CONVERTED = f"c AS (SELECT sample_id, {USER_CLIPPED}, {ITEM_CLIPPED}, {CLOCK} FROM samples)"


@query(
    "flat_layout",
    f"""WITH {S.samples_sql("user", "item")}, {CONVERTED}
SELECT sample_id, {sql_ids(FLAT_USER)} AS user_vector, {sql_ids(FLAT_ITEM)} AS item_vector,
  {sql_ids(f"({FLAT_USER})[4:8]")} AS slice_60 FROM c""",
)
def flat_layout(spark, sf_dir):
    """All id features of a side at fixed offsets, and one feature cut out again."""
    df = converted(spark, sf_dir, "user", "item").selectExpr(
        "sample_id", f"{flat_vector(LAYOUT, 'user')} AS u", f"{flat_vector(LAYOUT, 'item')} AS i"
    )
    return df.select(
        "sample_id",
        ids_text("u").alias("user_vector"),
        ids_text("i").alias("item_vector"),
        ids_text(A.feature_slice("u", LAYOUT.spans("user")[60])).alias("slice_60"),
    )


@query(
    "group_concat",
    f"""WITH {S.samples_sql("user", "item")}, {CONVERTED}
SELECT sample_id, concat_ws(',', user_int_feats_1, user_int_feats_15) AS user_group_1,
  {sql_ids("list_concat(list_concat([user_int_feats_48], user_int_feats_60), [h, d, w, p])")} AS user_group_2,
  concat_ws(',', item_int_feats_5, item_int_feats_11) AS item_group_1,
  {sql_ids("list_concat(item_int_feats_16, [item_hash])")} AS item_group_2 FROM c""",
)
def group_concat_query(spark, sf_dir):
    """Features joined by declared group; derived features end up in the last one."""
    df = converted(spark, sf_dir, "user", "item")
    grouped = group_concat(group_concat(df, LAYOUT, "user"), LAYOUT, "item")
    names = ["user_group_1", "user_group_2", "item_group_1", "item_group_2"]
    return grouped.select("sample_id", *[ids_text(n).alias(n) for n in names])


@query(
    "chunk_pad",
    f"""SELECT vec_id, {", ".join(
        sql_vec(f"list_resize(embedding::double[], 65, 0)[{i * 13 + 1}:{i * 13 + 13}]") + f" AS chunk_{i}" for i in range(5)
    )} FROM embeddings""",
)
def chunk_pad(spark, sf_dir):
    """Vectors zero-filled and cut into five equal chunks."""
    df = table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{A.chunk_pad('embedding', 64, 5)} AS c")
    return df.select("vec_id", *[vec_text(f"get(c, {i})").alias(f"chunk_{i}") for i in range(5)])


@query(
    "segments",
    f"""WITH {S.samples_sql("dense")}, v AS (SELECT sample_id, list_concat({S.pad_floats("user_dense_feats_89", 6)},
  {S.pad_floats("user_dense_feats_90", 4)}) AS x FROM samples)
SELECT sample_id, {sql_vec("x[1:6]")} AS segment_0, {sql_vec("list_resize(x[7:10], 6, 0)")} AS segment_1 FROM v""",
)
def segments(spark, sf_dir):
    """Two trend features of unequal length stacked to the longer one."""
    df = converted(spark, sf_dir, "dense").selectExpr(
        "sample_id", A.stack_segments("concat(user_dense_feats_89, user_dense_feats_90)", [6, 4]) + " AS s"
    )
    return df.select("sample_id", *[vec_text(f"get(s, {i})").alias(f"segment_{i}") for i in range(2)])


# ---- dense scaling ------------------------------------------------------------------

_ODD_SQL = """[value, CASE WHEN k % 7 = 0 THEN 'nan'::double ELSE k END,
  CASE WHEN k % 11 = 0 THEN 'inf'::double ELSE value - k END, CASE WHEN k % 13 = 0 THEN '-inf'::double ELSE -value END]"""


def _odd_vectors(spark, sf_dir):
    k, value = F.col("k"), F.col("value")
    return event_facts(spark, sf_dir).select(
        "event_id",
        F.array(
            value,
            F.when(k % 7 == 0, float("nan")).otherwise(k.cast("double")),
            F.when(k % 11 == 0, float("inf")).otherwise(value - k),
            F.when(k % 13 == 0, float("-inf")).otherwise(-value),
        ).alias("x"),
    )


def _finite_sql(top: str, bottom: str) -> str:
    return (
        "list_transform(x, lambda v: CASE WHEN isnan(v) THEN 0 WHEN isinf(v) THEN "
        f"CASE WHEN v > 0 THEN {top} ELSE {bottom} END ELSE v END)"
    )


@query(
    "dense_clean",
    f"""WITH {S.FACTS}, v AS (SELECT event_id, {_ODD_SQL} AS x FROM facts)
SELECT event_id, {sql_vec(_finite_sql("1000", "-1000"))} AS finite FROM v""",
)
def dense_clean(spark, sf_dir):
    """NaN and infinities replaced."""
    df = _odd_vectors(spark, sf_dir)
    return df.select("event_id", vec_text(D.nan_to_num("x", 0.0, 1000.0, -1000.0)).alias("finite"))


@query("dense_l2", f"SELECT vec_id, {sql_vec(S.l2('embedding::double[]'))} AS unit FROM embeddings")
def dense_l2(spark, sf_dir):
    """Vectors scaled to unit length."""
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", vec_text(D.l2_normalize("embedding")).alias("unit"))


@query(
    "dense_log_clamp",
    f"""WITH {S.FACTS}, v AS (SELECT event_id, {_ODD_SQL} AS x FROM facts),
f AS (SELECT event_id, {_finite_sql("0", "0")} AS y FROM v)
SELECT event_id, {sql_vec(S.log_clamp("y"))} AS logs FROM f""",
)
def dense_log_clamp(spark, sf_dir):
    """Clamped logarithms of raw statistics."""
    return _odd_vectors(spark, sf_dir).select("event_id", vec_text(D.log_clamp("x")).alias("logs"))


@query(
    "smooth_clip",
    f"""WITH {S.FACTS}, v AS (SELECT event_id, {_ODD_SQL} AS x FROM facts),
f AS (SELECT event_id, {_finite_sql("3", "-3")} AS y FROM v)
SELECT event_id, {sql_vec("list_transform(y, lambda v: v / sqrt(1 + (v / 3) * (v / 3)) * 2 + 1)")} AS clipped FROM f""",
)
def smooth_clip(spark, sf_dir):
    """Smoothly clipped, then scaled and shifted values."""
    df = _odd_vectors(spark, sf_dir)
    return df.select("event_id", vec_text(D.smooth_clip("x", 3.0, 2.0, 1.0)).alias("clipped"))


@query(
    "dense_groups",
    f"""WITH {S.samples_sql("dense")}, v AS (SELECT sample_id, {S.pad_floats("user_dense_feats_61", 64)} AS e,
  {S.pad_floats("user_dense_feats_62", 8)} AS t, {S.pad_floats("user_dense_feats_89", 6)} AS a,
  {S.pad_floats("user_dense_feats_90", 4)} AS b FROM samples)
SELECT sample_id, {sql_vec(S.l2("e"))} AS embedding_group, {sql_vec(S.log_clamp("t"))} AS statistic_group,
  {sql_vec("list_concat(a, list_resize(b, 6, 0))")} AS trend_group FROM v""",
)
def dense_groups_query(spark, sf_dir):
    """Dense features regrouped and scaled by meaning; absent features are skipped."""
    df = dense_groups(converted(spark, sf_dir, "dense"), LAYOUT, **DENSE_GROUPS)
    return df.select(
        "sample_id",
        vec_text("dense_embedding").alias("embedding_group"),
        vec_text("dense_statistic").alias("statistic_group"),
        vec_text("flatten(dense_trend)").alias("trend_group"),
    )
