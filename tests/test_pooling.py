import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from convfeat.operators.lookup import fits_broadcast, frequent_ids, hashed_lookup, lookup_embedding
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
    sequence_tokens,
    token_rows,
)

RNG = np.random.default_rng(4)
TABLE = {i: RNG.normal(size=3).round(3).tolist() for i in range(1, 30)}


@pytest.fixture
def table(spark):
    return spark.createDataFrame(list(TABLE.items()), "id long, vec array<double>")


def vec(i):
    return np.array(TABLE.get(i, [0.0] * 3)) if i else np.zeros(3)


def close(a, b):
    return np.allclose(a, b, atol=1e-12)


@pytest.fixture(params=["broadcast", "shuffle"])
def join_kind(request, setting):
    if request.param == "shuffle":
        setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    return request.param


def test_lookup_with_a_hot_id(spark, table, join_kind):
    ids = np.where(RNG.random(600) < 0.4, 5, RNG.integers(-1, 40, 600))
    rows = [(i, None if x == 39 else int(x)) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "row long, item long")
    assert fits_broadcast(table.limit(3)) == (join_kind == "broadcast")
    got = {r.row: r.vec for r in lookup_embedding(df, "item", table, 3, ["row"]).collect()}
    assert len(got) == len(rows) and all(close(got[i], vec(x if x and x > 0 else 0)) for i, x in rows)
    assert 5 in frequent_ids(df, "item", 0.1)


def test_gated_hash_lookup(spark, table, join_kind):
    df = spark.createDataFrame([(0, 7), (1, 0), (2, 14)], "row long, raw long")
    got = {r.row: r.vec for r in hashed_lookup(df, "raw", table, 7, -0.75, 3, ["row"]).collect()}
    gate = 1 / (1 + np.exp(0.75))
    assert close(got[0], vec(1) * gate) and close(got[1], vec(0)) and close(got[2], vec(1) * gate)


def test_mean_of_ids(spark, table, join_kind):
    rows = [(1, [3, 0, 4]), (2, [0, 0, 0]), (3, [9, 9, 1]), (4, None)]
    df = spark.createDataFrame(rows, "key long, ids array<long>")
    got = {r.key: r.vec for r in embed_mean(df, "key", "ids", table, 3).collect()}
    assert close(got[1], (vec(3) + vec(4)) / 2) and close(got[3], (2 * vec(9) + vec(1)) / 3)
    assert close(got[2], np.zeros(3)) and close(got[4], np.zeros(3))


SEQUENCES = [(1, [3, 0, 4, 0], 3, [1, 2, 3, 0]), (2, [0, 0, 0, 0], 0, [0] * 4), (3, [8, 0, 0, 0], 1, [5, 0, 0, 0])]


def converted(spark):
    return spark.createDataFrame(
        [(k, ids, n, gaps, TABLE[k]) for k, ids, n, gaps in SEQUENCES],
        "key long, s_1 array<long>, s_len int, s_time_bucket array<long>, query array<double>",
    )


def test_tokens_side_by_side(spark, table):
    sources = {1: TokenSource("table", table), 2: TokenSource("zero")}
    df = converted(spark).withColumn("s_2", F.col("s_1"))
    rows = sequence_tokens(df, "key", "s", sources, 3, table).collect()
    got = {(r.key, r.pos): r.token for r in rows}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, None), (3, 0)} and got[(2, None)] is None
    assert close(got[(1, 2)], np.concatenate([vec(4), np.zeros(3), vec(3)]))
    assert close(got[(1, 1)], np.concatenate([vec(0), np.zeros(3), vec(2)]))


def _jobs_while(spark, build):
    """Spark jobs started while ``build()`` makes its plan and runs it once."""
    tracker, group = spark.sparkContext.statusTracker(), f"counted-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        build()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


def test_one_lookup_for_all_side_features(spark, table, setting):
    """Shuffled tables: the jobs do not grow with the number of side features, hashed or not."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.enabled", "false")
    base = converted(spark)

    def tokens(n):
        df = base
        sources = {}
        for f in range(1, n + 1):
            df = df.withColumn(f"s_{f}", F.col("s_1"))
            sources[f] = TokenSource("hash", table, buckets=7, gate_logit=0.5) if f % 2 == 0 else TokenSource("table", table)
        return sequence_tokens(df, "key", "s", sources, 3, table)

    one = _jobs_while(spark, lambda: tokens(1).collect())
    five = _jobs_while(spark, lambda: tokens(5).collect())
    assert one == five
    got = {(r.key, r.pos): r.token for r in tokens(4).collect()}
    gate = 1 / (1 + np.exp(-0.5))
    hashed = lambda i: vec(i % 7 + 1) * gate if i > 0 else np.zeros(3)
    want = np.concatenate([vec(4), hashed(4), vec(4), hashed(4), vec(3)])
    assert close(got[(1, 2)], want) and got[(2, None)] is None


def softmax_mean(query, ids, score):
    tokens = np.array([vec(i) for i in ids])
    z = np.array([score(query, t) for t in tokens])
    w = np.exp(z - z.max())
    return (w[:, None] * tokens).sum(0) / w.sum()


@pytest.mark.parametrize("weights", [None, [float(x) for x in RNG.normal(size=12)]])
def test_attention(spark, table, weights):
    tokens = sequence_tokens(converted(spark), "key", "s", {1: TokenSource("table", table)}, 3, carry=["query"])

    def score(q, s):
        return q @ s if weights is None else np.concatenate([q, s, q - s, q * s]) @ np.array(weights)

    got = {r.key: r.vec for r in attention_pool(tokens, "key", 3, "query", weights).collect()}
    means = {r.key: r.vec for r in sequence_mean(tokens, "key", 3).collect()}
    for key, ids, n, _ in SEQUENCES:
        if n == 0:
            assert got[key] == means[key] == [0.0] * 3
        else:
            assert close(got[key], softmax_mean(vec(key), ids[:n], score))
            assert close(means[key], np.mean([vec(i) for i in ids[:n]], axis=0))


def test_attention_survives_large_scores(spark):
    rows = [(1, 0, [1000.0], [1.0]), (1, 1, [1000.0], [2.0]), (2, 0, [-1000.0], [3.0])]
    tokens = spark.createDataFrame(rows, "key long, pos int, query array<double>, token array<double>")
    got = {r.key: r.vec[0] for r in attention_pool(tokens, "key", 1, "query").collect()}
    assert got == {1: 2.0, 2: 3.0}


def test_wrong_weight_count(spark):
    rows = spark.createDataFrame([(1, 0, [1.0], [1.0])], "key long, pos int, query array<double>, token array<double>")
    with pytest.raises(ValueError):
        attention_pool(rows, "key", 1, "query", [1.0])


def test_match_features(spark, table):
    df = converted(spark).withColumn("ids", F.array(F.lit(2), F.lit(0)))
    df = df.withColumn("item", item_query(["query", "array(1D, 1D, 1D)"], 3))
    tokens = {"s": sequence_tokens(df, "key", "s", {1: TokenSource("table", table)}, 3, carry=["item"])}
    got = {r.key: r.match_s for r in match_features(df, "key", "item", "ids", table, 3, tokens, 3).collect()}
    query = (vec(3) + 1) / 2
    assert close(got[3], np.concatenate([query, vec(2), vec(8), vec(8)]))
    assert close(got[2][6:], np.zeros(6))


def _match_rows(spark):
    """Empty, missing and padded lists, a key twice with other ids, the null key twice."""
    rows = [
        (1, 4, [2, 0, 7], [3, 0, 4, 0], 3), (2, 0, [0, 0, 0], [0, 0, 0, 0], 0), (3, 99, None, [8, 8, 77, 5], 4), (4, 6, [5, 5, -1], None, 0),
        (5, 2, [9, 0, 0], [1, 2, 0, 0], 2), (5, 3, [1, 0, 0], [6, 5, 4, 0], 3), (None, 1, [1, 1, 1], [1, 0, 0, 0], 1), (None, 2, [2, 2, 2], [2, 0, 0, 0], 1),
    ]
    return spark.createDataFrame(rows, "key long, item_id long, ids array<long>, s_1 array<long>, s_len int")


@pytest.mark.parametrize("parts", [None, 5])
def test_late_vectors_match_the_carried(spark, table, parts):
    df, twice = _match_rows(spark), table.unionByName(table.where("id = 8"))
    late = LateVector("item", ["item_id"], lambda rows: lookup_embedding(rows, "item_id", table, 3, ["key"], "item").drop("item_id"))
    carried = late.add(df).cache()
    for source in (table, twice):
        sources = {1: TokenSource("table", source)}
        tokens = {"s": sequence_tokens(carried, "key", "s", sources, 3, carry=["item"])}
        want = sorted((r.key, r.match_s) for r in match_features(carried, "key", "item", "ids", table, 3, tokens, 3).collect())
        tokens = {"s": packed_tokens(df, "key", "s", sources, 3, parts=parts, late=late)}
        got = sorted((r.key, r.match_s) for r in match_features(df, "key", late, "ids", table, 3, tokens, 3).collect())
        assert [k for k, _ in got] == [k for k, _ in want] == [1, 2, 3, 4, 5, 5]
        assert all(close(a, b) for (_, a), (_, b) in zip(got, want))


def test_packed_pooling_of_vectors_with_nulls(spark):
    """A vector with a null or too few values leaves zeros as the weighted mean, packed or not."""
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [None, 1.0]), (3, [4.0]), (4, [float("nan"), 0.5])], "id long, vec array<double>")
    rows = [(k, ids, len(ids), [1.0, 0.5]) for k, ids in enumerate([[1, 9], [1, 2], [3, 1], [4, 1], []])]
    df = spark.createDataFrame(rows, "key long, s_1 array<long>, s_len int, query array<double>")
    plain = sequence_tokens(df, "key", "s", {1: TokenSource("table", table)}, 2, carry=["query"])
    packed = packed_tokens(df, "key", "s", {1: TokenSource("table", table)}, 2, carry=["query"])
    want, got = ({r.key: r.vec for r in attention_pool(t, "key", 2, "query").collect()} for t in (plain, packed))
    assert str(got) == str({k: want[k] for k in got}) and len(got) == 5 and got[1] == [0.0, 0.0]


def test_samples_of_a_task_are_bounded(spark, setting, monkeypatch):
    setting("spark.sql.shuffle.partitions", "3")
    assert sample_parts(spark.range(10)) == 3
    monkeypatch.setattr("convfeat.operators.pooling.SAMPLES", 2)
    assert sample_parts(spark.range(11)) == 6


def test_attention_plan_has_one_exchange_and_no_window(spark):
    rows = [(k, p, [float(k), float(p), 1.0], [0.5, -0.5, 1.0]) for k in range(6) for p in range(3)]
    tokens = spark.createDataFrame(rows, "key long, pos int, token array<double>, query array<double>")
    plan = attention_pool(tokens, "key", 3, "query")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_packed_tokens_equal_token_rows(spark, table, setting, threshold):
    setting("spark.sql.autoBroadcastJoinThreshold", threshold)
    twice = table.unionByName(table.where("id = 8"))  # an id with two rows
    rows = converted(spark).union(converted(spark).where("key = 1")).union(converted(spark).withColumn("key", F.col("key") + 10))
    sources = {1: TokenSource("table", twice), 2: TokenSource("hash", table, 7, 0.5)}
    df = rows.withColumn("s_2", F.col("s_1"))
    packed = packed_tokens(df, "key", "s", sources, 3, table, ["query"])
    plain = sequence_tokens(df, "key", "s", sources, 3, table, ["query"])
    got = {(r.key, r.pos): r.token for r in token_rows(packed).collect()}
    want = {(r.key, r.pos): r.token for r in plain.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] is want[k] is None or close(got[k], want[k]) for k in want)
    for weights in (None, [float(x) for x in range(12)]):
        got = {r.key: r.vec for r in attention_pool(packed, "key", 3, "query", weights).collect()}
        want = {r.key: r.vec for r in attention_pool(plain, "key", 3, "query", weights).collect()}
        assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)
    got = {r.key: r.vec for r in sequence_mean(packed, "key", 3).collect()}
    want = {r.key: r.vec for r in sequence_mean(plain, "key", 3).collect()}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want)


def test_packed_pooling_shuffles_no_vectors(spark, table):
    """The only exchange below the pooled rows is the one that groups id lists by sample."""
    packed = packed_tokens(converted(spark), "key", "s", {1: TokenSource("table", table.limit(29))}, 3, carry=["query"])
    for pooled in (sequence_mean(packed.rows, "key", 3), attention_pool(packed.rows, "key", 3, "query")):
        plan = pooled._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_large_table_is_cut_to_the_ids_looked_up(spark, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "20000")
    wide = spark.range(1, 40000).select("id", F.array_repeat(F.col("id").cast("double"), 64).alias("vec"))
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    df = spark.createDataFrame([(1, 5), (2, 39999), (3, 50000)], "row long, item long")
    assert not fits_broadcast(wide)
    found = lookup_embedding(df, "item", wide, 64, ["row"])
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.row: r.vec[0] for r in found.collect()} == {1: 5.0, 2: 39999.0, 3: 0.0}
