"""Queries for voting, evaluation and profiles of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlabel.operators import evaluation as E
from tierlabel.operators.voting import vote
from tierlabel.plans import inputs
from tierlabel.plans.registry import query

# Items, their three votes, the vote, and the labels of the voted class, as SQL.
PREDICTIONS_SQL = """
    gpc AS (SELECT p_partkey AS row_idx, nullif(p_type, 'PROMO') AS SegmentTitle, p_brand AS FamilyTitle,
                   nullif(p_name, 'hot gear') AS ClassTitle FROM part),
    first_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ClassTitle ORDER BY row_idx) AS rn
                                 FROM gpc WHERE ClassTitle IS NOT NULL) z WHERE rn = 1),
    voters AS (SELECT p_partkey AS item_id, p_type AS segment, p_brand AS family, p_name AS class,
                      min_by(p_name, p_partkey) OVER (PARTITION BY p_type, p_brand, p_size) AS embed_class,
                      min_by(p_name, p_partkey) OVER (PARTITION BY p_brand, p_size) AS brand_class,
                      min_by(p_name, p_partkey) OVER (PARTITION BY p_type, p_size) AS clf_class FROM part),
    voted AS (SELECT *, CASE WHEN embed_class = brand_class OR embed_class = clf_class THEN embed_class
                             WHEN brand_class = clf_class THEN brand_class ELSE clf_class END AS pred_class,
                     CASE WHEN embed_class = brand_class AND brand_class = clf_class THEN 3
                          WHEN embed_class = brand_class OR embed_class = clf_class OR brand_class = clf_class THEN 2
                          ELSE 1 END AS votes FROM voters),
    preds AS (SELECT item_id, segment, family, class, embed_class, brand_class, clf_class, pred_class,
                     votes / 3.0e0 AS confidence_rate,
                     CASE votes WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS confidence_level,
                     SegmentTitle AS pred_segment, FamilyTitle AS pred_family, ClassTitle IS NOT NULL AS in_taxonomy
              FROM voted LEFT JOIN first_row ON ClassTitle = pred_class)"""


def predictions(spark, sf):
    return vote(inputs.voters(spark, sf), inputs.taxonomy(spark, sf))


def _three(template: str) -> str:
    """The same SELECT for each level."""
    return " UNION ALL ".join(template.format(level=lv) for lv in E.LEVELS)


@query("v13_vote", f"WITH {PREDICTIONS_SQL} SELECT * REPLACE (round(confidence_rate, 9) AS confidence_rate) FROM preds")
def voted(spark, sf):
    return predictions(spark, sf).withColumn("confidence_rate", F.round("confidence_rate", 9))


@query(
    "e01_accuracy",
    f"""WITH {PREDICTIONS_SQL}
        SELECT round(avg(CASE WHEN segment = pred_segment THEN 1.0e0 ELSE 0.0e0 END), 9) AS segment_accuracy,
               round(avg(CASE WHEN family = pred_family THEN 1.0e0 ELSE 0.0e0 END), 9) AS family_accuracy,
               round(avg(CASE WHEN class = pred_class THEN 1.0e0 ELSE 0.0e0 END), 9) AS class_accuracy FROM preds""",
)
def accuracy(spark, sf):
    return E.accuracy(predictions(spark, sf))


_LABELS_SQL = """
    obs AS (SELECT {o} AS label, CAST(count(*) AS BIGINT) AS support, CAST(sum(CASE WHEN {o} = {p} THEN 1 ELSE 0 END) AS BIGINT) AS hits
            FROM preds WHERE {o} IS NOT NULL GROUP BY {o}),
    prd AS (SELECT {p} AS label, CAST(count(*) AS BIGINT) AS predicted FROM preds
            WHERE {o} IS NOT NULL AND {p} IS NOT NULL GROUP BY {p}),
    lab AS (SELECT coalesce(obs.label, prd.label) AS label, coalesce(support, 0) AS support,
                   coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
            FROM obs FULL JOIN prd ON obs.label = prd.label),
    sc AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0e0 ELSE hits / CAST(predicted AS DOUBLE) END AS p,
                  CASE WHEN support = 0 THEN 0.0e0 ELSE hits / CAST(support AS DOUBLE) END AS r,
                  CASE WHEN predicted + support = 0 THEN 0.0e0 ELSE 2 * hits / CAST(predicted + support AS DOUBLE) END AS f
           FROM lab)"""


@query(
    "e02_label_scores",
    f"""WITH {PREDICTIONS_SQL}, {_LABELS_SQL.format(o='class', p='pred_class')}
        SELECT label, support, predicted, hits, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM sc""",
)
def label_scores(spark, sf):
    return E.label_scores(predictions(spark, sf), "class", "pred_class")


@query(
    "e02_segment_scores",
    f"""WITH {PREDICTIONS_SQL}, {_LABELS_SQL.format(o='segment', p='pred_segment')}
        SELECT label, support, predicted, hits, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM sc""",
)
def segment_scores(spark, sf):
    return E.label_scores(predictions(spark, sf), "segment", "pred_segment", 6)


@query(
    "e02_classification_summary",
    f"""WITH {PREDICTIONS_SQL}, {_LABELS_SQL.format(o='family', p='pred_family')}
        SELECT CAST(count(*) AS BIGINT) AS n_labels, CAST(sum(support) AS BIGINT) AS n_rows,
               round(sum(hits) / CAST(sum(support) AS DOUBLE), 9) AS accuracy,
               round(sum(hits) / CAST(sum(predicted) AS DOUBLE), 9) AS micro_precision,
               round(avg(p), 9) AS macro_precision, round(sum(p * support) / sum(support), 9) AS weighted_precision,
               round(sum(hits) / CAST(sum(support) AS DOUBLE), 9) AS micro_recall,
               round(avg(r), 9) AS macro_recall, round(sum(r * support) / sum(support), 9) AS weighted_recall,
               round(2 * sum(hits) / CAST(sum(predicted) + sum(support) AS DOUBLE), 9) AS micro_f1,
               round(avg(f), 9) AS macro_f1, round(sum(f * support) / sum(support), 9) AS weighted_f1 FROM sc""",
)
def classification_summary(spark, sf):
    return E.classification_summary(predictions(spark, sf), "family", "pred_family")


@query(
    "e03_level_distribution",
    f"""WITH {PREDICTIONS_SQL}, counts AS ({_three("SELECT '{level}' AS level, {level} AS label, count(*) AS n FROM preds WHERE {level} IS NOT NULL GROUP BY {level}")}),
        ranked AS (SELECT level, label, n, sum(n) OVER (PARTITION BY level ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) AS cumulative,
                          row_number() OVER (PARTITION BY level ORDER BY n DESC, label) AS place,
                          sum(n) OVER (PARTITION BY level) AS total, count(*) OVER (PARTITION BY level) AS labels FROM counts)
        SELECT level, label, CAST(n AS BIGINT) AS n, CAST(cumulative AS BIGINT) AS cumulative,
               round(n * 100.0e0 / total, 9) AS share, place, place <= 3 AS top_3, place <= 5 AS top_5,
               place > labels - 5 AS bottom_5 FROM ranked""",
)
def level_distribution(spark, sf):
    return E.all_levels(E.level_distribution, inputs.items(spark, sf))


@query(
    "e04_pareto_cutoff",
    f"""WITH {PREDICTIONS_SQL}, counts AS ({_three("SELECT '{level}' AS level, {level} AS label, count(*) AS n FROM preds GROUP BY {level}")}),
        ranked AS (SELECT level, label, sum(n) OVER (PARTITION BY level ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) AS cumulative,
                          sum(n) OVER (PARTITION BY level) AS total FROM counts)
        SELECT level, share, max_by(label, cumulative) FILTER (WHERE cumulative <= total * share) AS label
        FROM ranked, (VALUES (0.7e0), (0.9e0)) s(share) GROUP BY level, share""",
)
def pareto_cutoff(spark, sf):
    return E.all_levels(E.pareto_cutoff, inputs.items(spark, sf))


@query(
    "e05_taxonomy_coverage",
    f"""WITH {PREDICTIONS_SQL}, c AS (
          SELECT 'segment' AS level, count(DISTINCT pred_segment) AS used, (SELECT count(DISTINCT p_type) FROM part) AS defined FROM preds
          UNION ALL SELECT 'family', count(DISTINCT pred_family), (SELECT count(DISTINCT p_brand) FROM part) FROM preds
          UNION ALL SELECT 'class', count(DISTINCT pred_class), (SELECT count(DISTINCT p_name) FROM part) FROM preds)
        SELECT level, CAST(used AS BIGINT) AS used, CAST(defined AS BIGINT) AS defined, round(used * 100.0e0 / defined, 9) AS coverage FROM c""",
)
def taxonomy_coverage(spark, sf):
    used = predictions(spark, sf).select(
        F.col("pred_segment").alias("segment"), F.col("pred_family").alias("family"), F.col("pred_class").alias("class")
    )
    return E.taxonomy_coverage(used, inputs.full_taxonomy(spark, sf))


_CONFIDENCE_SQL = """SELECT '{level}' AS level, confidence_level FROM preds WHERE {level} IS NOT NULL"""


def _confidence_sql(condition: str) -> str:
    return f"""WITH {PREDICTIONS_SQL}, c AS ({_three(_CONFIDENCE_SQL + condition)})
        SELECT level, round(avg(CASE WHEN confidence_level = 'Low' THEN 100.0e0 ELSE 0.0e0 END), 9) AS low,
               round(avg(CASE WHEN confidence_level = 'Medium' THEN 100.0e0 ELSE 0.0e0 END), 9) AS medium,
               round(avg(CASE WHEN confidence_level = 'High' THEN 100.0e0 ELSE 0.0e0 END), 9) AS high
        FROM c GROUP BY level"""


@query("e06_confidence_full", _confidence_sql(""))
def confidence_full(spark, sf):
    return E.confidence_distribution(predictions(spark, sf))


@query("e06_confidence_correct", _confidence_sql(" AND {level} = pred_{level}"))
def confidence_correct(spark, sf):
    return E.confidence_distribution(predictions(spark, sf), "correct")


@query("e06_confidence_incorrect", _confidence_sql(" AND {level} IS DISTINCT FROM pred_{level}"))
def confidence_incorrect(spark, sf):
    return E.confidence_distribution(predictions(spark, sf), "incorrect")


_RESULTS_SQL = f"""WITH {PREDICTIONS_SQL}, r AS ({_three(
    "SELECT '{level}' AS level, {level} AS label, count(*) AS total, "
    "sum(CASE WHEN {level} = pred_{level} THEN 1 ELSE 0 END) AS correct FROM preds WHERE {level} IS NOT NULL GROUP BY {level}")})"""


@query(
    "e07_classification_results",
    f"""{_RESULTS_SQL}
        SELECT level, label, CAST(correct AS BIGINT) AS correct, CAST(total - correct AS BIGINT) AS incorrect,
               CAST(total AS BIGINT) AS total, row_number() OVER (PARTITION BY level ORDER BY total DESC, label) AS place,
               row_number() OVER (PARTITION BY level ORDER BY correct DESC, label) <= 5 AS top_5,
               row_number() OVER (PARTITION BY level ORDER BY correct DESC, label) > count(*) OVER (PARTITION BY level) - 5 AS bottom_5 FROM r""",
)
def classification_results(spark, sf):
    return E.all_levels(E.classification_results, predictions(spark, sf))


@query(
    "e07_classification_percentages",
    f"""{_RESULTS_SQL}, s AS (SELECT level, label, total, round(correct * 100.0e0 / total, 9) AS correct,
                                     round((total - correct) * 100.0e0 / total, 9) AS incorrect FROM r)
        SELECT level, label, correct, incorrect, CAST(total AS BIGINT) AS total,
               row_number() OVER (PARTITION BY level ORDER BY total DESC, label) AS place,
               row_number() OVER (PARTITION BY level ORDER BY correct DESC, label) <= 5 AS top_5,
               row_number() OVER (PARTITION BY level ORDER BY correct DESC, label) > count(*) OVER (PARTITION BY level) - 5 AS bottom_5 FROM s""",
)
def classification_percentages(spark, sf):
    return E.all_levels(E.classification_results, predictions(spark, sf), mode="percentage")


_SUBLEVEL_SQL = """s AS (SELECT {u} AS upper_label, {s} AS sub_label,
    CAST(sum(CASE WHEN {u} = pred_{u} THEN 1 ELSE 0 END) AS BIGINT) AS correct,
    CAST(sum(CASE WHEN {u} = pred_{u} THEN 0 ELSE 1 END) AS BIGINT) AS incorrect, CAST(count(*) AS BIGINT) AS total
    FROM preds WHERE {u} IS NOT NULL AND {s} IS NOT NULL GROUP BY {u}, {s})"""


@query(
    "e08_results_by_sublevel",
    f"""WITH {PREDICTIONS_SQL}, {_SUBLEVEL_SQL.format(u='segment', s='family')}
        SELECT *, row_number() OVER (PARTITION BY upper_label ORDER BY total DESC, sub_label) AS place FROM s""",
)
def results_by_sublevel(spark, sf):
    return E.results_by_sublevel(predictions(spark, sf), "segment", "family")


@query(
    "e08_sublevel_summary",
    f"""WITH {PREDICTIONS_SQL}, {_SUBLEVEL_SQL.format(u='family', s='class')}
        SELECT upper_label, CAST(count(*) AS BIGINT) AS n_sub_labels, CAST(sum(total) AS BIGINT) AS total,
               CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(incorrect) AS BIGINT) AS incorrect,
               round(sum(correct) * 100.0e0 / sum(total), 9) AS accuracy FROM s GROUP BY upper_label""",
)
def sublevel_summary(spark, sf):
    return E.sublevel_summary(predictions(spark, sf), "family", "class")
