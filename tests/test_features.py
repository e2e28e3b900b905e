import pytest
from pyspark.sql import functions as F

from convfeat.layout import DenseFeature, FeatureLayout, IdFeature, SequenceDomain
from convfeat.operators.features import convert, dense_groups, flatten_layout, project_layout
from convfeat.operators.oob import oob_stats
from convfeat.sources.samples import read_samples, write_oob_report

LAYOUT = FeatureLayout(
    user_ids=(IdFeature(1, 10), IdFeature(2, 0), IdFeature(3, 10, 3)),
    item_ids=(IdFeature(5, 4),),
    user_dense=(DenseFeature(61, 2),),
    domains=(
        SequenceDomain("seq_a", "act", 9, ((7, 100), (8, 50), (9, 0)), 3),
        SequenceDomain("seq_b", "buy", None, ((4, 100),), 2),
    ),
    sample_clock=True,
    event_clock=True,
    item_buckets=5,
)
SCHEMA = (
    "timestamp long, label_type int, user_id string, item_id long, user_int_feats_1 long, user_int_feats_2 long, "
    "user_int_feats_3 array<long>, item_int_feats_5 long, user_dense_feats_61 array<float>, act_7 array<long>, "
    "act_8 array<long>, act_9 array<long>, buy_4 array<long>, unused string"
)
ROWS = [
    (57_600, 2, "u", 6, 9, 3, [1, -1, 10, 4], 4, [1.5], [5, 100, 7, 8], [1], [57_590, 0, -5], [3, 4, 5], "x"),
    (None, None, "v", None, None, None, None, None, None, None, None, None, None, "y"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def test_conversion(raw):
    full, empty = convert(project_layout(raw, LAYOUT), LAYOUT).collect()
    assert (full.label, full.user_int_feats_1, full.user_int_feats_2) == (1, 9, 0)
    assert full.user_int_feats_3 == [1, 0, 0] and full.item_int_feats_5 == 0
    assert full.item_int_feats_1300001 == 1 and full.user_int_feats_1200001 == 1
    assert full.user_dense_feats_61 == [1.5, 0.0]
    assert full.seq_a_7 == [5, 0, 7] and full.seq_a_8 == [1, 0, 0] and full.seq_a_len == 3
    assert full.seq_a_time_bucket == [2, 0, 45] and full.seq_b_time_bucket == [0, 0]
    assert full.seq_a_1400001 == [24, 0, 0] and full.seq_a_1400002 == [4, 0, 0]
    assert full.seq_b_4 == [3, 4] and full.seq_b_1400001 == [0, 0]
    assert empty.label == 0 and empty.timestamp == 0 and empty.seq_a_len == 0
    assert empty.seq_a_7 == [0, 0, 0] and empty.user_int_feats_3 == [0, 0, 0]
    assert empty.user_dense_feats_61 == [0.0, 0.0] and empty.item_int_feats_1300001 == 0


def test_labels_are_not_read_when_scoring(raw):
    assert [r.label for r in convert(raw.drop("label_type"), LAYOUT, training=False).collect()] == [0, 0]


def test_projection_checks_and_prunes(raw):
    assert "unused" not in project_layout(raw, LAYOUT).columns
    with pytest.raises(KeyError, match="item_id"):
        project_layout(raw.drop("item_id"), LAYOUT)


def test_flat_vector_has_the_declared_width(raw):
    df = flatten_layout(convert(raw, LAYOUT), LAYOUT, "user", "flat")
    assert {len(r.flat) for r in df.collect()} == {LAYOUT.width("user")} == {9}
    assert df.first().flat == [9, 0, 1, 0, 0, 1, 5, 1, 1]


def test_out_of_vocabulary_report(spark, raw, tmp_path):
    report = oob_stats(raw, LAYOUT)
    got = {(r.feature_group, r.fid): (r.vocab, r.oob_count, r.oob_min, r.oob_max) for r in report.collect()}
    assert got == {
        ("user_int", 3): (10, 1, 10, 10),
        ("item_int", 5): (4, 1, 4, 4),
        ("seq_a", 7): (100, 1, 100, 100),
    }
    write_oob_report(report, str(tmp_path / "oob"))
    assert spark.read.option("header", True).csv(str(tmp_path / "oob")).count() == 3


def test_raise_mode(raw):
    with pytest.raises(Exception, match="not in"):
        convert(raw, LAYOUT, mode="raise").collect()


def test_empty_dense_groups_are_zero(raw):
    df = dense_groups(convert(raw, LAYOUT), LAYOUT, embedding=(61, 87), statistic=(62,), trend=(89,))
    row = df.first()
    assert row.dense_embedding == [1.0, 0.0] and row.dense_statistic == [0.0] and row.dense_trend == [[0.0]]


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|UNABLE_TO_INFER"):
        read_samples(spark, str(tmp_path / "none")).count()


def test_places_of_rows(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "data"))
    df = read_samples(spark, str(tmp_path / "data"))
    assert df.filter(F.col("file_path").isNull() | F.col("row_index").isNull()).count() == 0


def test_training_needs_labels(spark):
    df = spark.range(3).selectExpr("id as user_id", "id as timestamp")
    with pytest.raises(KeyError):
        convert(df, FeatureLayout())
    assert {r.label for r in convert(df, FeatureLayout(), training=False).collect()} == {0}
