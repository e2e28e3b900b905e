from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from convfeat.fixtures.history import with_histories
from convfeat.fixtures.samples import LAYOUT, samples

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_equals_brute_force_with_a_hot_user(spark, parts):
    rng = np.random.default_rng(2)
    users = np.where(rng.random(400) < 0.4, 7, rng.integers(0, 12, 400))
    rows = [
        (i, int(t), int(u), "ab"[int(d)])
        for i, (t, u, d) in enumerate(zip(rng.integers(0, 150, 400), users, rng.random(400) < 0.15))
    ]
    events = spark.createDataFrame(rows, "event_id long, event_ts long, user_id long, domain string")
    got = with_histories(events, {"a": 6, "b": 2}, ["event_id"], parts).collect()
    assert len(got) == len(rows)
    for r in got:
        for domain in "ab":
            earlier = sorted(
                ((t, i) for i, t, u, d in rows if u == r.user_id and d == domain and (t, i) < (r.event_ts, r.event_id)),
                reverse=True,
            )
            assert [e.event_id for e in r[f"hist_{domain}"]] == [i for _, i in earlier[: {"a": 6, "b": 2}[domain]]]


def test_depth_follows_the_layout(spark):
    deep = replace(LAYOUT, domains=tuple(replace(d, max_len=64) for d in LAYOUT.domains))
    rows = samples(spark, SF, ("seq",), layout=deep).select("sample_id", "seq_a_101", "seq_d_104").collect()
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "event_id", "user_id", "ts", "event_type", "bigint(get_json_object(props, '$.k')) k").collect()
    of = {e.event_id: e for e in events}
    for r in rows[::7]:
        own = of[r.sample_id]
        earlier = sorted((e for e in events if e.user_id == own.user_id and (e.ts, e.event_id) < (own.ts, own.event_id)),
                         key=lambda e: (e.ts, e.event_id), reverse=True)
        assert list(r.seq_a_101 or []) == [e.k for e in earlier if e.event_type == "view"][:64]
        assert list(r.seq_d_104 or []) == [e.k for e in earlier if e.event_type in ("error", "signup")][:64]


def test_samples_do_not_depend_on_ranges(spark):
    one, many = (samples(spark, SF, ("seq",), chunks) for chunks in (1, 9))
    assert one.exceptAll(many).count() == 0 and one.count() == 600


def test_sample_table(spark):
    df = samples(spark, SF, ("user", "item", "dense"))
    assert df.count() == df.select("sample_id").distinct().count() == 600
    missing = df.filter("user_int_feats_1 IS NULL OR item_int_feats_5 IS NULL OR user_dense_feats_61 IS NULL")
    assert missing.count() == 0
    assert df.filter((F.col("item_id").isNull()) != (F.col("k") == 50)).count() == 0
