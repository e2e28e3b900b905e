"""Lookup, pooling and matching of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from convfeat.catalog import sql as S
from convfeat.catalog.features import ITEM_CLIPPED, PACKED, converted
from convfeat.catalog.registry import query, rounded, sql_rounded, sql_vec, vec_text
from convfeat.fixtures.samples import LAYOUT, event_facts, samples, table
from convfeat.layout import ITEM_HASH_FID, FeatureLayout
from convfeat.operators.lookup import hashed_lookup, lookup_embedding, needed_table
from convfeat.operators.pooling import (
    LateVector,
    TokenSource,
    attention_pool,
    embed_mean,
    item_query,
    match_features,
    packed_tokens,
    sample_parts,
    sequence_mean,
    token_rows,
)
from convfeat.operators.selection import recent_thresholds
from convfeat.session import stored

W = 64  # width of the vectors of ``embeddings``
GATE = -0.75
ITEM_HASH = FeatureLayout.id_column("item", ITEM_HASH_FID)
LINEAR = [((i * 7) % 11 - 5) / 10 for i in range(4 * W)]


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _vec_sql(width: int = W, scale: str = "") -> str:
    zero = f"list_resize([]::double[], {width}, 0)"
    vec = f"embedding[1:{width}]::double[]"
    return f"coalesce({f'list_transform({vec}, lambda x: x * {scale})' if scale else vec}, {zero})"


@query(
    "embed_lookup",
    f"""WITH {S.samples_sql()} SELECT sample_id, {sql_vec(_vec_sql())} AS vec
FROM samples LEFT JOIN embeddings ON vec_id = item_id AND vec_id > 0""",
)
def embed_lookup(spark, sf_dir):
    """The vector of each sample's item; zeros for missing items."""
    df = samples(spark, sf_dir).select("sample_id", "item_id")
    found = lookup_embedding(df, "item_id", vectors(spark, sf_dir), W, ["sample_id"])
    return found.select("sample_id", vec_text("vec").alias("vec"))


@query(
    "hashed_gate",
    f"""WITH {S.FACTS} SELECT event_id, {sql_vec(_vec_sql(W, f"(1 / (1 + exp({-GATE}::double)))"))} AS vec
FROM facts LEFT JOIN embeddings ON vec_id = (event_id + 1) % 300 + 1""",
)
def hashed_gate(spark, sf_dir):
    """Vectors of hashed ids, scaled by a gate."""
    facts = event_facts(spark, sf_dir).select("event_id", (F.col("event_id") + 1).alias("raw"))
    found = hashed_lookup(facts, "raw", vectors(spark, sf_dir), 300, GATE, W, ["event_id"])
    return found.select("event_id", vec_text("vec").alias("vec"))


# Elementwise sums in DuckDB: one row per dimension, then back to a list.
_DIMS = f"range(1, {W + 1}) dims(d)"
USER_MEAN = f"""user_mean AS (
  SELECT sample_id, list(m ORDER BY d) AS user_vec FROM (
    SELECT sample_id, d, sum(coalesce(embedding[d]::double, 0)) / count(*) AS m
    FROM (SELECT sample_id, unnest(list_filter({S.pad("user_int_feats_60", 5, 150)}, lambda x: x <> 0)) AS id FROM samples)
    LEFT JOIN embeddings ON vec_id = id, {_DIMS} GROUP BY sample_id, d) GROUP BY sample_id)"""
ZERO = f"list_resize([]::double[], {W}, 0)"


@query(
    "embed_mean",
    f"""WITH {S.samples_sql("user")}, {USER_MEAN}
SELECT sample_id, {sql_vec(f"coalesce(user_vec, {ZERO})")} AS vec FROM samples LEFT JOIN user_mean USING (sample_id)""",
)
def embed_mean_query(spark, sf_dir):
    """Mean vector of a user's order ids, missing ids left out."""
    df = converted(spark, sf_dir, "user")
    pooled = embed_mean(df, "sample_id", "user_int_feats_60", vectors(spark, sf_dir), W)
    return pooled.select("sample_id", vec_text("vec").alias("vec"))


def tokens_sql(domain: str, fid: int, name: str) -> str:
    """CTE of (sample_id, pos, token) for one table-backed side feature."""
    return f"""{name} AS (
  SELECT sample_id, i AS pos, {_vec_sql()} AS token
  FROM (SELECT sample_id, unnest(range(0, {domain}_len)) AS i, p_{domain}_{fid} AS ids FROM packed)
  LEFT JOIN embeddings ON vec_id = ids[i + 1] AND vec_id > 0)"""


PACKED_CTE = f"packed AS (SELECT sample_id, {PACKED} FROM samples)"


def mean_sql(tokens: str, name: str) -> str:
    return f"""{name} AS (SELECT sample_id, list(m ORDER BY d) AS mean_vec FROM (
  SELECT sample_id, d, avg(token[d]) AS m FROM {tokens}, {_DIMS} GROUP BY sample_id, d) GROUP BY sample_id)"""


def attention_sql(tokens: str, name: str, score: str) -> str:
    return f"""{name}_scored AS (
  SELECT sample_id, token, {score} AS score FROM {tokens} JOIN queries USING (sample_id)),
{name}_weighted AS (
  SELECT sample_id, token, exp(score - max(score) OVER (PARTITION BY sample_id)) AS w FROM {name}_scored),
{name} AS (SELECT sample_id, list(a ORDER BY d) AS att_vec FROM (
  SELECT sample_id, d, sum(w * token[d]) / sum(w) AS a FROM {name}_weighted, {_DIMS} GROUP BY sample_id, d) GROUP BY sample_id)"""


DOT = "list_sum(list_transform(range(1, %d), lambda i: query[i] * token[i]))" % (W + 1)
_WEIGHTS = "[" + ", ".join(f"{x}::double" for x in LINEAR) + "]"
WEIGHED = (
    f"list_sum(list_transform(range(1, {W + 1}), lambda i: query[i] * {_WEIGHTS}[i] + token[i] * {_WEIGHTS}[i + {W}] "
    f"+ (query[i] - token[i]) * {_WEIGHTS}[i + {2 * W}] + query[i] * token[i] * {_WEIGHTS}[i + {3 * W}]))"
)
QUERIES_SQL = f"""item_ids AS (SELECT sample_id, {ITEM_CLIPPED} FROM samples),
queries AS (
  SELECT i.sample_id, list_transform(range(1, {W + 1}), lambda d:
    (coalesce(a.embedding[d]::double, 0) + coalesce(b.embedding[d]::double, 0)) / 2) AS query
  FROM item_ids i LEFT JOIN embeddings a ON a.vec_id = item_hash AND a.vec_id > 0
  LEFT JOIN embeddings b ON b.vec_id = item_int_feats_5 AND b.vec_id > 0)"""


def with_query(df, spark, sf_dir, table_=None):
    """``query``: the mean of the vectors of the hashed item and of its size."""
    table_ = vectors(spark, sf_dir) if table_ is None else table_
    found = lookup_embedding(df, ITEM_HASH, table_, W, ["sample_id"], "__hash_vec")
    found = lookup_embedding(found, "item_int_feats_5", table_, W, ["sample_id"], "__size_vec")
    return found.withColumn("query", item_query(["__hash_vec", "__size_vec"], W)).drop("__hash_vec", "__size_vec")


@query(
    "item_query",
    f"""WITH {S.samples_sql("item")}, {QUERIES_SQL} SELECT sample_id, {sql_vec("query")} AS query FROM queries""",
)
def item_query_query(spark, sf_dir):
    """Mean of the item-side vectors."""
    df = with_query(converted(spark, sf_dir, "item"), spark, sf_dir)
    return df.select("sample_id", vec_text("query").alias("query"))


@query(
    "seq_tokens",
    f"""WITH {S.samples_sql("seq")}, {PACKED_CTE}, positions AS (
  SELECT sample_id, unnest(range(0, seq_b_len)) AS i, p_seq_b_102, p_seq_b_69,
    list_transform(list_resize(coalesce(seq_b_29, [])[1:8], 8, 0), lambda t: {S.bucket("timestamp", "t")}) AS gaps
  FROM packed JOIN samples USING (sample_id))
SELECT sample_id, i::int AS pos, {sql_vec(f"list_concat(list_concat(coalesce(a.embedding::double[], {ZERO}), "
  f"coalesce(list_transform(b.embedding::double[], lambda x: x / (1 + exp({-GATE}::double))), {ZERO})), "
  f"coalesce(c.embedding::double[], {ZERO}))")} AS token
FROM positions LEFT JOIN embeddings a ON a.vec_id = p_seq_b_102[i + 1] AND a.vec_id > 0
LEFT JOIN embeddings b ON b.vec_id = p_seq_b_69[i + 1] % 400 + 1 AND p_seq_b_69[i + 1] > 0
LEFT JOIN embeddings c ON c.vec_id = gaps[i + 1] AND c.vec_id > 0""",
)
def seq_tokens(spark, sf_dir):
    """Table, gated hash and time-gap vectors side by side for every event of a domain."""
    table_ = vectors(spark, sf_dir)
    sources = {102: TokenSource("table", table_), 69: TokenSource("hash", table_, 400, GATE)}
    packed = packed_tokens(converted(spark, sf_dir, "seq"), "sample_id", "seq_b", sources, W, table_)
    rows = token_rows(packed)
    return rows.filter("pos IS NOT NULL").select("sample_id", "pos", vec_text("token").alias("token"))


def _view_tokens(df, spark, sf_dir, carry=()):
    return packed_tokens(
        df, "sample_id", "seq_a", {101: TokenSource("table", vectors(spark, sf_dir))}, W, carry=carry
    )


@query(
    "seq_mean",
    f"""WITH {S.samples_sql("seq")}, {PACKED_CTE}, {tokens_sql("seq_a", 101, "tokens")}, {mean_sql("tokens", "means")}
SELECT sample_id, {sql_vec(f"coalesce(mean_vec, {ZERO})")} AS vec FROM samples LEFT JOIN means USING (sample_id)""",
)
def seq_mean(spark, sf_dir):
    """Mean over the valid positions of the viewed items."""
    tokens = _view_tokens(converted(spark, sf_dir, "seq"), spark, sf_dir)
    return sequence_mean(tokens, "sample_id", W).select("sample_id", vec_text("vec").alias("vec"))


def _attention_query(score: str) -> str:
    return f"""WITH {S.samples_sql("item", "seq")}, {PACKED_CTE}, {QUERIES_SQL},
{tokens_sql("seq_a", 101, "tokens")}, {attention_sql("tokens", "pooled", score)}
SELECT sample_id, {sql_vec(f"coalesce(att_vec, {ZERO})")} AS vec FROM samples LEFT JOIN pooled USING (sample_id)"""


@query("attention_pool", _attention_query(DOT))
def attention_pool_query(spark, sf_dir):
    """Viewed items weighted by their dot product with the item at hand."""
    df = with_query(converted(spark, sf_dir, "item", "seq"), spark, sf_dir)
    tokens = _view_tokens(df, spark, sf_dir, ["query"])
    return attention_pool(tokens, "sample_id", W, "query").select("sample_id", vec_text("vec").alias("vec"))


@query("attention_linear", _attention_query(WEIGHED))
def attention_linear(spark, sf_dir):
    """Viewed items weighted by a supplied linear scorer."""
    df = with_query(converted(spark, sf_dir, "item", "seq"), spark, sf_dir)
    tokens = _view_tokens(df, spark, sf_dir, ["query"])
    return attention_pool(tokens, "sample_id", W, "query", LINEAR).select("sample_id", vec_text("vec").alias("vec"))


MATCHED_SQL = f"""{PACKED_CTE}, {QUERIES_SQL}, {USER_MEAN},
{tokens_sql("seq_a", 101, "ta")}, {mean_sql("ta", "ma")}, {attention_sql("ta", "aa", DOT)},
{tokens_sql("seq_c", 103, "tc")}, {mean_sql("tc", "mc")}, {attention_sql("tc", "ac", DOT)},
matched AS (
  SELECT sample_id, list_concat(list_concat(query, coalesce(user_vec, {ZERO})),
      list_concat(coalesce(ma.mean_vec, {ZERO}), coalesce(aa.att_vec, {ZERO}))) AS match_seq_a,
    list_concat(list_concat(query, coalesce(user_vec, {ZERO})),
      list_concat(coalesce(mc.mean_vec, {ZERO}), coalesce(ac.att_vec, {ZERO}))) AS match_seq_c
  FROM queries LEFT JOIN user_mean USING (sample_id) LEFT JOIN ma USING (sample_id) LEFT JOIN aa USING (sample_id)
  LEFT JOIN mc USING (sample_id) LEFT JOIN ac USING (sample_id))"""


def matched(spark, sf_dir):
    """Samples as stored, and their match vectors.

    Stored and dealt by sample are ids alone; every vector, the query too, is looked up behind the
    exchange. If the vectors that the samples need fit no broadcast, or an id has several, the query
    is looked up first.
    """
    table_ = vectors(spark, sf_dir).withColumn("id", F.col("id").cast("long"))
    item = [ITEM_HASH, "item_int_feats_5"]
    read = ["sample_id", "timestamp", "label", "user_int_feats_60", *item]
    read += ["seq_a_101", "seq_a_len", "seq_c_103", "seq_c_len"]
    df = stored(converted(spark, sf_dir, "user", "item", "seq").select(*read), "features")
    ids = F.concat(F.array(*item), "user_int_feats_60", "seq_a_101", "seq_c_103")
    small = needed_table(table_, "id", df.select(F.explode(ids).alias("id")))
    if small is None or small.where("id > 0").groupBy("id").count().where("count > 1").limit(1).collect():
        df, late, query_ = stored(with_query(df, spark, sf_dir), "queries"), None, "query"
    else:
        table_ = small
        late = query_ = LateVector("query", item, lambda rows: with_query(rows, spark, sf_dir, small).drop(*item))
    parts = sample_parts(df)
    tokens = {
        d.name: packed_tokens(
            df, "sample_id", d.name, {d.side_features[0][0]: TokenSource("table", table_)}, W,
            carry=() if late else ["query"], parts=parts, late=late,
        )
        for d in LAYOUT.domains
        if d.name in ("seq_a", "seq_c")
    }
    dealt = df.repartition(parts, "sample_id")
    return df, match_features(dealt, "sample_id", query_, "user_int_feats_60", table_, W, tokens, W)


@query(
    "match_features",
    f"""WITH {S.samples_sql("user", "item", "seq")}, {MATCHED_SQL}
SELECT sample_id, {sql_vec("match_seq_a")} AS match_seq_a, {sql_vec("match_seq_c")} AS match_seq_c FROM matched""",
)
def match_features_query(spark, sf_dir):
    """Item, user and history vectors side by side, for two domains."""
    _, features = matched(spark, sf_dir)
    return features.select(
        "sample_id", vec_text("match_seq_a").alias("match_seq_a"), vec_text("match_seq_c").alias("match_seq_c")
    )


@query(
    "match_summary",
    f"""WITH {S.samples_sql("user", "item", "seq")}, {MATCHED_SQL}, splits AS (
  SELECT 'train' AS split, {S.threshold("samples", 0.90, "timestamp")} AS t UNION ALL
  SELECT 'valid', {S.threshold("samples", 0.016, "timestamp")})
SELECT split, CASE WHEN label_type = 2 THEN 1 ELSE 0 END::int AS label, count(*) AS row_count,
  {", ".join(sql_rounded(f"avg(match_seq_a[{i + 1}])") + f" AS view_match_{i}" for i in range(4 * W))}
FROM matched JOIN samples USING (sample_id) JOIN splits ON timestamp >= t GROUP BY ALL""",
)
def match_summary(spark, sf_dir):
    """Flagship: samples -> features -> matching -> mean match vector per split and label."""
    low, high = recent_thresholds(samples(spark, sf_dir), [0.90, 0.016])
    df, features = matched(spark, sf_dir)
    labelled = features.join(df.select("sample_id", "label", "timestamp"), "sample_id")
    splits = F.filter(
        F.array(
            F.when(F.col("timestamp") >= low, F.lit("train")), F.when(F.col("timestamp") >= high, F.lit("valid"))
        ),
        lambda s: s.isNotNull(),
    )
    exploded = labelled.withColumn("split", F.explode(splits))
    return exploded.groupBy("split", "label").agg(
        F.count("*").alias("row_count"),
        *[rounded(F.avg(F.get("match_seq_a", F.lit(i)))).alias(f"view_match_{i}") for i in range(4 * W)],
    )
