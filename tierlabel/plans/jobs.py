"""Jobs from files to files: classify an item list, and profile labelled predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlabel.operators import evaluation as E
from tierlabel.operators.tables import left_merge_predictions
from tierlabel.plans.ensemble import Ensemble
from tierlabel.session import cut_lineage
from tierlabel.sources.tables import read_table, with_row_index, write_csv


def classify_file(spark: SparkSession, ensemble: Ensemble, path: str, schema: str, output: str, **options) -> None:
    """Classify every distinct ``product_name`` of a file and write its rows, one per name, with the predictions.

    The numbered items are checkpointed: the classified names and the rows they are joined back to must
    carry the same numbers.
    """
    items = cut_lineage(with_row_index(read_table(spark, path, schema)))
    names = items.groupBy("product_name").agg(F.min("row_idx").alias("row_idx"))
    predictions = ensemble.flat(names, item_id="row_idx", keep=("row_idx",), **options)
    write_csv(left_merge_predictions(items, predictions).drop("row_idx"), output)


def profile_reports(predictions: DataFrame, dataset: DataFrame, taxonomy: DataFrame) -> dict[str, DataFrame]:
    """Every report on a labelled dataset and its predictions, by name; nothing runs yet."""
    reports = {
        "coverage": E.taxonomy_coverage(dataset, taxonomy),
        "accuracy": E.accuracy(predictions),
        "distribution": E.all_levels(E.level_distribution, dataset),
        "pareto": E.all_levels(E.pareto_cutoff, dataset),
    }
    for mode in ("full", "correct", "incorrect"):
        reports[f"confidence_{mode}"] = E.confidence_distribution(predictions, mode)
    for mode in ("absolute", "percentage"):
        reports[f"results_{mode}"] = E.all_levels(E.classification_results, predictions, mode=mode)
    for upper, sub in (("segment", "family"), ("family", "class")):
        reports[f"results_{upper}_by_{sub}"] = E.results_by_sublevel(predictions, upper, sub)
        reports[f"summary_{upper}_by_{sub}"] = E.sublevel_summary(predictions, upper, sub)
    for level in E.LEVELS:
        reports[f"scores_{level}"] = E.label_scores(predictions, level, f"pred_{level}")
        reports[f"score_summary_{level}"] = E.classification_summary(predictions, level, f"pred_{level}")
    return reports


def write_profile(predictions: DataFrame, dataset: DataFrame, taxonomy: DataFrame, folder: str) -> list[str]:
    """Write every report as CSV below ``folder``. The label columns are read once and kept for all reports."""
    used = [*E.LEVELS, *[f"pred_{lv}" for lv in E.LEVELS], "confidence_level"]
    kept = predictions.select(*[c for c in used if c in predictions.columns]).persist()
    labels = dataset.select(*E.LEVELS).persist()
    reports = profile_reports(kept, labels, taxonomy)
    for name, report in reports.items():
        write_csv(report, f"{folder}/{name}")
    kept.unpersist()
    labels.unpersist()
    return sorted(reports)
