"""Votes and measures on rows that the given tables lack."""

import pytest
from row_helpers import rows
from pyspark.sql import functions as F

from tierlabel.operators import evaluation as E
from tierlabel.operators.voting import vote


@pytest.fixture
def gpc(spark):
    return spark.createDataFrame(
        [(0, "s1", "f1", "a"), (1, "s2", "f2", "b"), (2, "s3", "f3", "c"), (3, "s9", "f9", "a")],
        "row_idx long, SegmentTitle string, FamilyTitle string, ClassTitle string",
    )


def test_vote(spark, gpc):
    votes = [("a", "a", "a"), ("a", "a", "b"), ("a", "b", "a"), ("b", "a", "a"), ("a", "b", "c"), (None, None, "a"), ("a", None, "c")]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(votes)], "i int, embed_class string, brand_class string, clf_class string")
    got = vote(df, gpc).orderBy("i").collect()
    assert [r.pred_class for r in got] == ["a", "a", "a", "a", "c", None, "c"]
    assert [round(r.confidence_rate * 3) for r in got] == [3, 2, 2, 2, 1, 2, 1]
    assert [r.confidence_level for r in got] == ["High", "Medium", "Medium", "Medium", "Low", "Medium", "Low"]
    assert [(r.pred_segment, r.pred_family) for r in got][:5] == [("s1", "f1")] * 4 + [("s3", "f3")]
    assert got[5].pred_segment is None and not got[5].in_taxonomy


@pytest.fixture
def preds(spark):
    data = [
        ("s1", "f1", "a", "s1", "f1", "a", "High"),
        ("s1", "f1", "a", "s2", "f2", "b", "Low"),
        ("s1", "f2", "b", None, None, None, "Low"),
        (None, "f2", "b", "s1", "f2", "b", "Medium"),
        ("s2", None, "c", "s2", "f3", "c", "Medium"),
    ]
    return spark.createDataFrame(
        data,
        "segment string, family string, class string, pred_segment string, pred_family string, pred_class string, confidence_level string",
    )


def test_accuracy_counts_nulls_as_wrong(preds):
    assert rows(E.accuracy(preds)) == [(0.4, 0.4, 0.6)]


def test_labels_never_predicted_or_never_observed(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "x"), ("b", "a"), ("a", None)], "o string, p string")
    got = {r.label: r for r in E.label_scores(df, "o", "p").collect()}
    assert (got["a"].support, got["a"].predicted, got["a"].hits) == (2, 2, 1)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.0, 0.0, 0.0)
    assert (got["x"].support, got["x"].recall) == (0, 0.0)
    summary = E.classification_summary(df, "o", "p").first()
    assert (summary.n_labels, summary.n_rows, summary.accuracy) == (3, 4, 0.25)
    with pytest.raises(Exception, match="expected 2 labels, found 3"):
        E.label_scores(df, "o", "p", num_labels=2).collect()


def test_pareto_without_a_label_below_the_share(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 1 + [("c",)] * 1, "segment string")
    assert rows(E.pareto_cutoff(df, "segment")) == [(0.7, None), (0.9, "b")]


def test_distribution_of_few_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("c",)], "segment string")
    got = [(r.label, r.n, r.cumulative, r.share, r.place, r.bottom_5) for r in E.level_distribution(df, "segment").orderBy("place").collect()]
    assert got == [("a", 2, 2, 50.0, 1, True), ("b", 1, 3, 25.0, 2, True), ("c", 1, 4, 25.0, 3, True)]


def test_confidence_modes(preds):
    full = {r.level: (r.low, r.medium, r.high) for r in E.confidence_distribution(preds).collect()}
    wrong = {r.level: (r.low, r.medium, r.high) for r in E.confidence_distribution(preds, "incorrect").collect()}
    right = {r.level: (r.low, r.medium, r.high) for r in E.confidence_distribution(preds, "correct").collect()}
    assert full["segment"] == (50.0, 25.0, 25.0)
    assert wrong["segment"] == (100.0, 0.0, 0.0)
    assert right["segment"] == (0.0, 50.0, 50.0)
    assert all(abs(sum(v) - 100) < 1e-6 for v in full.values())
    assert [r.level for r in E.confidence_distribution(preds.drop("pred_family")).collect()] == ["segment", "class"]
    with pytest.raises(ValueError):
        E.confidence_distribution(preds, "other")


def test_coverage(preds, gpc):
    got = {r.level: (r.used, r.defined) for r in E.taxonomy_coverage(preds, gpc).collect()}
    assert got == {"segment": (2, 4), "family": (2, 4), "class": (3, 3)}


def test_sublevels(preds):
    got = rows(E.results_by_sublevel(preds, "segment", "family").select("upper_label", "sub_label", "correct", "incorrect"))
    assert got == [("s1", "f1", 1, 1), ("s1", "f2", 0, 1)]
    assert rows(E.sublevel_summary(preds, "segment", "family").select("upper_label", "n_sub_labels", "total", F.round("accuracy", 3))) == [("s1", 2, 3, 33.333)]


def test_running_sums_over_ranges(spark):
    from tierlabel.operators.groups import running_sums

    data = [(g, i, (i * 7) % 5) for g in ("a", "b", None) for i in range(50 if g else 3)]
    df = spark.createDataFrame(data, "g string, i int, v long").repartition(5)
    got = running_sums(df, "g", [F.desc("v"), F.asc("i")], {"upto": F.col("v"), "place": F.lit(1)})
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    for g in ("a", "b", None):
        own = sorted([(-v, i) for x, i, v in data if x == g])
        found = {r.i: (r.upto, r.place, r.upto_total, r.place_total) for r in got.collect() if r.g == g}
        total = -sum(v for v, _ in own)
        assert found == {i: (-sum(v for v, _ in own[: k + 1]), k + 1, total, len(own)) for k, (_, i) in enumerate(own)}
    assert running_sums(df.limit(0), "g", [F.asc("i")], {"upto": F.col("v")}).collect() == []


def test_levels_come_from_one_scan(spark, small):
    from tierlabel.plans.evaluation_queries import predictions

    rows_ = predictions(spark, small)
    for operator in (E.level_distribution, E.classification_results):
        found = E.all_levels(operator, rows_)
        for level in E.LEVELS:
            assert rows(found.filter(F.col("level") == level).drop("level")) == rows(operator(rows_, level))
