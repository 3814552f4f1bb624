from __future__ import annotations

from pyspark.sql import functions as F

from tierlabel.llm.common import table
from tierlabel.llm.registry import query
from tierlabel.llm.warc import read_archives, write_archives

# DuckDB has no base32: each five-bit group of the digest is looked up in the alphabet.
SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS hex FROM p
), o AS (
  SELECT hex, max(page_id) AS original FROM d GROUP BY hex
), b AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1), '' ORDER BY i) AS digest
  FROM o, range(32) AS r(i) GROUP BY hex
)
SELECT d.page_id, d.n AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN d.page_id = o.original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = o.original THEN NULL ELSE o.original END AS refers_to
FROM d JOIN o USING (hex) JOIN b USING (hex)
"""


def _page(urn: str):
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")


@query("op4_warc_round_trip", SQL)
def op4(spark, folder):
    records = read_archives(spark, write_archives(table(spark, folder, "pages")), with_payload=False)
    return records.filter("gap IS NULL").select(
        _page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        _page("refers_to").alias("refers_to"),
    )
