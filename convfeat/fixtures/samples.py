"""The derived sample table and its layout.

One sample per click, purchase or view event. Parts are joined only when a query asks for
them: ``user``, ``item``, ``dense``, ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convfeat.fixtures.history import with_histories
from convfeat.layout import DenseFeature, FeatureLayout, IdFeature, SequenceDomain
from convfeat.operators.lookup import keyed_join, needed_table

# Market segments in name order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

LAYOUT = FeatureLayout(
    user_ids=(IdFeature(1, 20), IdFeature(15, 6), IdFeature(48, 0), IdFeature(60, 150, 5)),
    item_ids=(IdFeature(5, 51), IdFeature(11, 20), IdFeature(16, 60, 4)),
    user_dense=(DenseFeature(61, 64), DenseFeature(62, 8), DenseFeature(89, 6), DenseFeature(90, 4)),
    domains=(
        SequenceDomain("seq_a", "seq_a", 29, ((101, 90), (29, 0)), 8),
        SequenceDomain("seq_b", "seq_b", 29, ((102, 100), (69, 2_000_000), (29, 0)), 8),
        SequenceDomain("seq_c", "seq_c", 29, ((103, 100), (34, 1_500_000), (29, 0)), 16),
        SequenceDomain("seq_d", "seq_d", None, ((104, 0),), 16),
    ),
    sample_clock=True,
    event_clock=True,
    item_buckets=40,
    groups={"user": {"U1": (1, 15), "U2": (48, 60)}, "item": {"I1": (5, 11), "I2": (16,)}},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts"):
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with plain integer fields and its sequence domain."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("event_ts"),
        "user_id",
        "event_type",
        "value",
        seconds().alias("sec"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.when(kind == "view", "seq_a").when(kind == "click", "seq_b").when(kind == "purchase", "seq_c").otherwise("seq_d").alias("domain"),
    )


def first_per_key(df: DataFrame, key: str, order: str, depth: int) -> DataFrame:
    """The first ``depth`` rows of each key; the limit also applies before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= depth).drop("__rank")


def order_depth(layout: FeatureLayout) -> int:
    """The longest list that a feature of the layout reads from a customer's orders."""
    read = [f.dim for f in layout.user_ids if f.fid == 60] + [f.dim for f in layout.user_dense if f.fid in (62, 89, 90)]
    return max(read, default=1)


def customer_orders(spark: SparkSession, sf_dir: str, layout: FeatureLayout = LAYOUT) -> DataFrame:
    """Per customer: the first orders as parallel lists, and the largest total of all orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top_total"))
    first = first_per_key(orders, "o_custkey", "o_orderkey", order_depth(layout))
    lists = first.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("l")
    )
    return lists.join(top, "o_custkey").select(
        F.col("o_custkey").alias("user_id"),
        F.transform("l", lambda x: F.pmod(x["o_orderkey"], F.lit(200))).alias("order_ids"),
        F.transform("l", lambda x: x["o_totalprice"]).alias("order_totals"),
        F.transform("l", lambda x: x["o_totalprice"] / F.col("top_total")).alias("order_ratios"),
    )


def user_table(spark: SparkSession, sf_dir: str, parts: Sequence[str], layout: FeatureLayout = LAYOUT) -> DataFrame:
    """Everything a sample takes from its user, one row per user."""
    users = customer_orders(spark, sf_dir, layout)
    columns = ["user_id"]
    if "user" in parts:
        customers = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("user_id"),
            (F.col("c_nationkey").cast("long") - 1).alias("user_int_feats_1"),
            F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).alias("user_int_feats_15"),
            F.col("c_custkey").alias("user_int_feats_48"),
        )
        users = customers.join(users, "user_id", "left")
        columns += ["user_int_feats_1", "user_int_feats_15", "user_int_feats_48"]
        columns.append(F.col("order_ids").alias("user_int_feats_60"))
    if "dense" in parts:
        vectors = table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("user_id"), F.col("embedding").alias("user_dense_feats_61")
        )
        users = users.join(vectors, "user_id", "full")
        columns += [
            "user_dense_feats_61",
            F.col("order_totals").alias("user_dense_feats_62"),
            F.col("order_ratios").alias("user_dense_feats_89"),
            F.col("order_ratios").alias("user_dense_feats_90"),
        ]
    return users.select(*columns)


def samples(
    spark: SparkSession, sf_dir: str, parts: Sequence[str] = (), chunks: int | None = None, layout: FeatureLayout = LAYOUT
) -> DataFrame:
    """Samples with the asked parts; lists are as deep as the layout reads them (``max_len``, ``dim``)."""
    events = facts = event_facts(spark, sf_dir)
    columns = [
        F.col("event_id").alias("sample_id"),
        F.col("sec").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).alias("label_type"),
        "user_id",
        F.when(F.col("k") != 50, F.col("k") - 1).alias("item_id"),
        "k",
        "value",
    ]
    if "seq" in parts:
        fields = ("event_id", "sec", "k", "cents")
        facts = with_histories(facts, {d.name: d.max_len for d in layout.domains}, fields, chunks)

        def listed(domain: str, value):
            return F.transform(f"hist_{domain}", value)

        columns += [
            listed("seq_a", lambda e: e["k"]).alias("seq_a_101"),
            listed("seq_a", lambda e: e["sec"]).alias("seq_a_29"),
            listed("seq_b", lambda e: e["k"]).alias("seq_b_102"),
            listed("seq_b", lambda e: e["event_id"] + 1).alias("seq_b_69"),
            listed("seq_b", lambda e: e["sec"]).alias("seq_b_29"),
            listed("seq_c", lambda e: e["k"]).alias("seq_c_103"),
            listed("seq_c", lambda e: e["cents"]).alias("seq_c_34"),
            listed("seq_c", lambda e: e["sec"]).alias("seq_c_29"),
            listed("seq_d", lambda e: e["k"]).alias("seq_d_104"),
        ]
    rows = facts.filter(F.col("event_type").isin("click", "purchase", "view")).select(*columns)
    if "user" in parts or "dense" in parts:
        rows = keyed_join(rows, user_table(spark, sf_dir, parts, layout), "user_id", ["sample_id"], events)
    if "item" in parts:
        size = F.col("p_size").cast("long")
        items = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("k"),
            size.alias("item_int_feats_5"),
            F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("item_int_feats_11"),
            F.array(size, F.lit(-1), size * 2).alias("item_int_feats_16"),
        )
        needed = needed_table(items, "k", events)
        rows = keyed_join(rows, items if needed is None else needed, "k", ["sample_id"], events)
    return rows
