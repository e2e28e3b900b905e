import numpy as np
import pytest
from pyspark.sql import functions as F

from convfeat.functions import arrays as A
from convfeat.functions import calendar as C
from convfeat.functions import dense as D
from convfeat.functions.ids import clean_id, clip_vocab, hash_item, hash_seq, route_feature, routed_id
from convfeat.functions.scoring import sigmoid
from convfeat.layout import FeatureLayout, IdFeature


def values(spark, schema, rows, *texts):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) for r in df.select(*[F.expr(t).alias(f"c{i}") for i, t in enumerate(texts)]).collect()]


def test_clean_and_clip(spark):
    rows = [(-1,), (0,), (9,), (10,), (None,)]
    got = values(spark, "x long", rows, clip_vocab(clean_id("x"), 10), clip_vocab(clean_id("x"), 0))
    assert got == [(0, 0), (0, 0), (9, 0), (0, 0), (0, 0)]


def test_clip_can_fail_the_job(spark):
    text = clip_vocab(clean_id("x"), 10, "raise", "feature")
    assert values(spark, "x long", [(9,)], text) == [(9,)]
    with pytest.raises(Exception, match="not in"):
        values(spark, "x long", [(10,)], text)
    with pytest.raises(ValueError):
        clip_vocab("x", 10, "ignore")


def test_hashes(spark):
    rows = [(5,), (6,), (0,), (None,), (-3,)]
    got = values(spark, "x long", rows, hash_item("x", 5), hash_seq("x", 5))
    assert got == [(5, 1), (1, 2), (0, 0), (0, 0), (0, 0)]


def test_hash_range(spark):
    ids = [(int(x),) for x in np.random.default_rng(1).integers(1, 2**62, 500)]
    got = values(spark, "x long", ids, hash_item("x", 97), hash_seq("x", 97))
    assert all(1 <= a <= 97 and 1 <= b <= 97 for a, b in got)


def test_routes():
    allow = {"seq_b": {69}, "seq_c": {29, 34, 47}}
    assert route_feature("seq_b", 69, 2_000_000, 1_000_000, 500, allow) == "hash"
    assert route_feature("seq_b", 70, 2_000_000, 1_000_000, 500, allow) == "zero"
    assert route_feature("seq_b", 69, 2_000_000, 1_000_000, 0, allow) == "zero"
    assert route_feature("seq_b", 69, 0, 1_000_000, 500, allow) == "zero"
    assert route_feature("seq_x", 1, 1_000_000, 1_000_000, 500, allow) == "table"
    assert route_feature("seq_x", 1, 2_000_000, 0, 500, allow) == "table"
    assert route_feature("seq_x", 1, 2_000_000, 1_000_000, 500, {}, hash_all=True) == "hash"
    assert routed_id("k", "zero", 5) == "0L" and routed_id("k", "table", 5) == "k"


def test_bucket_edges(spark):
    gaps = [0, 5, 6, 10, 60, 61, 15_552_000, 15_552_001, 31_536_001]
    rows = [(1_700_000_000, 1_700_000_000 - g) for g in gaps]
    got = [r[0] for r in values(spark, "s long, e long", rows, C.time_bucket("s", "e"))]
    assert got == [1, 1, 2, 2, 12, 13, 62, 63, 63]


def test_future_zero_and_negative_events(spark):
    rows = [(100, 200), (100, 0), (100, -5)]
    assert [r[0] for r in values(spark, "s long, e long", rows, C.time_bucket("s", "e"))] == [1, 0, 13]
    assert values(spark, "e long", [(-5,), (0,)], C.event_hour("e"), C.event_day("e")) == [(0, 0), (0, 0)]


def test_bucket_equals_sorted_search(spark):
    rng = np.random.default_rng(7)
    gaps = np.unique(np.concatenate([rng.integers(0, 40_000_000, 3000), np.array(C.GAP_EDGES), np.array(C.GAP_EDGES) + 1]))
    rows = [(2_000_000_000, int(2_000_000_000 - g)) for g in gaps]
    got = [r[0] for r in values(spark, "s long, e long", rows, C.time_bucket("s", "e"))]
    want = np.clip(np.searchsorted(np.array(C.GAP_EDGES), gaps), 0, len(C.GAP_EDGES) - 1) + 1
    assert got == want.tolist()
    assert got == sorted(got) and len(C.GAP_EDGES) == 63 and C.GAP_BUCKETS == 64


def test_calendar(spark):
    rows = [(0,), (57_600,), (-1,), (-28_801,)]
    assert values(spark, "t long", rows, *C.sample_clock("t")) == [
        (9, 4, 1, 2),
        (1, 5, 1, 1),
        (8, 4, 1, 2),
        (24, 3, 1, 4),
    ]


def test_padding(spark):
    rows = [(None,), ([],), ([1],), ([1, -1, 2, 3],), ([None, 4],)]
    got = values(spark, "a array<long>", rows, A.pad_ids("a", 3), A.valid_length("a", 3))
    assert got == [([0, 0, 0], 0), ([0, 0, 0], 0), ([1, 0, 0], 1), ([1, 0, 2], 3), ([0, 4, 0], 2)]
    assert values(spark, "a array<long>", [([-7, 1],)], A.pad_raw("a", 3)) == [([-7, 1, 0],)]
    [(padded,)] = values(spark, "a array<float>", [([float("nan"), 2.0, 3.0],)], A.pad_floats("a", 2))
    assert np.isnan(padded[0]) and padded[1] == 2.0
    assert values(spark, "a array<long>", [([9, 10],)], A.clip_vocab_array("a", 10)) == [([9, 0],)]


def test_latest_and_mask(spark):
    rows = [([7, 0, 0], 1), ([7, 8, 9], 3), ([0, 0, 0], 0)]
    got = values(spark, "a array<long>, n int", rows, A.latest_k("a", "n", 2), A.padding_mask("n", 3))
    assert got == [([7], [False, True, True]), ([8, 9], [False] * 3), ([], [True] * 3)]


def test_chunks_and_segments(spark):
    rows = [([1.0, 2.0, 3.0, 4.0, float("nan")],)]
    got = values(
        spark, "v array<double>", rows, A.chunk_pad("slice(v, 1, 4)", 4, 3), A.stack_segments("v", [2, 3]), A.feature_slice("v", (1, 2))
    )
    assert got == [([[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]], [[1.0, 2.0, 0.0], [3.0, 4.0, 0.0]], [2.0, 3.0])]


def test_dense_scaling(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([float("inf"), float("nan")],)]
    got = values(spark, "v array<double>", rows, D.l2_normalize("v"), D.log_clamp("v"), D.smooth_clip("v"))
    assert got[0][0] == pytest.approx([0.6, 0.8])
    assert got[1] == ([0.0, 0.0], [0.0, 0.0], [0.0, 0.0])
    assert got[2][0] == [0.0, 0.0] and got[2][1] == [0.0, 0.0]
    assert got[2][2] == pytest.approx([3 / 2**0.5, 0.0])
    assert got[0][1] == pytest.approx(np.log1p([3.0, 4.0]).tolist())
    [(big,)] = values(spark, "v array<double>", [([1e300, -5.0],)], D.log_clamp("v"))
    assert big == [20.0, 0.0]


def test_sigmoid_is_stable(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "z double").coalesce(1)
    assert [r[0] for r in df.select(sigmoid(F.col("z"))).collect()] == [0.0, 0.5, 1.0]


def test_layout_groups_and_offsets():
    layout = FeatureLayout(
        user_ids=(IdFeature(1, 20), IdFeature(60, 150, 5)), item_ids=(IdFeature(5, 51),), sample_clock=True, item_buckets=40
    )
    assert layout.spans("user")[60] == (1, 5) and layout.width("user") == 10
    assert layout.feature_groups("user") == [[1], [60, 1_200_001, 1_200_002, 1_200_003, 1_200_004]]
    assert layout.feature_groups("item") == [[5, 1_300_001]]
    with pytest.raises(KeyError):
        layout.with_groups({"user_ns_groups": {"U1": [2]}}).feature_groups("user")
    assert FeatureLayout.from_json(layout.to_json()) == layout
