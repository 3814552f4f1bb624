from __future__ import annotations

from pyspark.sql import functions as F

from tierlabel.llm.common import table
from tierlabel.llm.mixing import MixSettings, apply_plan, cycled_weights, mixing_plan, sized
from tierlabel.llm.registry import query

SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), keyed AS (
  SELECT *, md5('42:' || coalesce(doc_id::VARCHAR, '')) || lpad(size::VARCHAR, 12, '0') AS k FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ([3, 1, 2])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM sources)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WHERE cap > 0
), water AS (
  SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, source LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN cap > 0 THEN least(cap, coalesce((SELECT level FROM water), 'inf'::DOUBLE) * w)
                                   ELSE 0 END AS target FROM sources
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         floor(target + 0.5)::BIGINT AS rounded FROM targets
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.rounded - p.whole * p.source_size AS budget,
         count(*) OVER (PARTITION BY d.source, k) AS m,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY k RANGE UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM keyed d JOIN passes p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= budget THEN size
                            WHEN upto - m * size >= budget THEN 0
                            ELSE (budget - (upto - m * size)) // m END)::BIGINT AS taken
FROM placed
"""


@query("op1_mix_sources", SQL)
def op1(spark, folder):
    settings = MixSettings()
    sizes = sized(table(spark, folder, "documents"), settings)
    plan = mixing_plan(sizes, cycled_weights(sizes), 1.5, settings)
    rows = sizes.withColumnsRenamed({"__id": "doc_id", "__source": "source"})
    mixed = apply_plan(rows.withColumnRenamed("__size", "words"), plan, F.col("words"), settings)
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )
