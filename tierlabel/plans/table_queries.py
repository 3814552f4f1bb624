"""Queries for sources, table rewrites, joins, grouping and text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tierlabel.functions import text as X
from tierlabel.operators import groups as G
from tierlabel.operators import tables as T
from tierlabel.plans import inputs
from tierlabel.plans.inputs import table
from tierlabel.plans.registry import query
from tierlabel.session import scratch_path
from tierlabel.sources import tables as S

PART_SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _new_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------------------------------


@query("s01_read_parquet", "SELECT * FROM customer")
def read_parquet(spark, sf):
    return S.read_table(spark, f"{sf}/customer.parquet")


@query("s01_s03_csv_round_trip", "SELECT * FROM part")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "part") + ".csv"
    S.write_csv(table(spark, sf, "part"), path)
    return S.read_table(spark, path, PART_SCHEMA)


@query("s01_csv_texts", "SELECT doc_id, text FROM documents")
def csv_texts(spark, sf):
    """Texts with line breaks and quotes survive the way through CSV."""
    path = scratch_path(spark, "documents") + ".csv"
    S.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return S.read_table(spark, path, "doc_id long, text string", multiline=True)


@query(
    "s01_row_index",
    """SELECT row_number() OVER (ORDER BY p_partkey % 7 <> 0, p_partkey) - 1 AS row_idx, p_partkey, p_name FROM part""",
)
def row_index(spark, sf):
    """Several files of unequal size, numbered in file order: the small ones come first by name."""
    path, part = scratch_path(spark, "parts"), table(spark, sf, "part").select("p_partkey", "p_name")
    for name, rows in (("a", part.filter("p_partkey % 7 = 0")), ("b", part.filter("p_partkey % 7 <> 0"))):
        S.write_csv(rows.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey"), f"{path}/{name}.csv")
    files = spark.read.option("header", True).schema("p_partkey long, p_name string").csv([f"{path}/{n}.csv" for n in "ab"])
    return S.with_row_index(files)


@query("s02_read_workbooks", "SELECT * FROM customer")
def read_workbooks(spark, sf):
    """Tasks write workbooks to the shared folder; they are read back as files."""
    path = scratch_path(spark, "books")
    inputs.write_workbooks(table(spark, sf, "customer"), path).count()
    return S.read_workbooks(spark, path, CUSTOMER_SCHEMA)


@query("s04_s05_saved_table", "SELECT * FROM supplier UNION ALL SELECT * FROM supplier")
def saved_table(spark, sf):
    name = _new_name("saved_supplier")
    S.insert_table(table(spark, sf, "supplier"), name)
    S.insert_table(table(spark, sf, "supplier"), name, "append")
    return S.get_table(spark, name)


@query(
    "s06_execute_query",
    """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY o_orderpriority""",
)
def execute_query(spark, sf):
    return S.execute_query(
        spark,
        f"""SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
            FROM parquet.`{sf}/orders.parquet` GROUP BY o_orderpriority""",
    )


@query("s07_s08_create_and_drop", "SELECT * FROM supplier")
def create_and_drop(spark, sf):
    kept, dropped = _new_name("kept"), _new_name("dropped")
    for name in (kept, dropped):
        S.create_table(
            spark, name, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["bigint", "CV", "I", "F"]
        )
        S.insert_table(table(spark, sf, "supplier"), name, "append")
    S.drop_table(spark, dropped)
    return S.get_table(spark, kept)


@query(
    "s09_sample_rows",
    """SELECT doc_id, lang, source FROM documents
       ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 3""",
)
def sample_rows(spark, sf):
    return S.sample_rows(table(spark, sf, "documents").select("doc_id", "lang", "source"), 3, "doc_id")


@query(
    "s10_describe_schema",
    """SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
              CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint'
                             WHEN 'DOUBLE' THEN 'double' END AS data_type
       FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'supplier')""",
)
def describe_schema(spark, sf):
    database = _new_name("described")
    spark.sql(f"CREATE DATABASE {database}")
    for name in ("customer", "nation", "supplier"):
        S.insert_table(table(spark, sf, name), f"{database}.{name}")
    return S.describe_schema(spark, database)


# --- table rewrites -----------------------------------------------------------------------------------


@query("t01_rename_columns", "SELECT n_nationkey AS id, n_name AS nation, n_regionkey FROM nation")
def rename_columns(spark, sf):
    return T.rename_columns(table(spark, sf, "nation"), {"n_nationkey": "id", "n_name": "nation", "absent": "x"})


@query("t02_drop_column", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_column(spark, sf):
    return T.drop_column(table(spark, sf, "customer"), ["c_nationkey", "c_acctbal"])


@query("t03_replicate_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def replicate_table(spark, sf):
    return T.replicate_table(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "t04_drop_null_rows",
    "SELECT doc_id, lang, source FROM documents WHERE lang <> 'fr' AND source <> 'src3'",
)
def drop_null_rows(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), F.nullif("source", F.lit("src3")).alias("source")
    )
    return T.drop_null_rows(docs, ["lang", "source"])


@query(
    "t05_combine_columns",
    """SELECT p_partkey, p_name, p_brand, trim(p_brand || ' ' || nullif(p_type, 'PROMO') || ' ' || p_name || ' ') AS full_name
       FROM part""",
)
def combine_columns(spark, sf):
    part = table(spark, sf, "part")
    kind = F.nullif("p_type", F.lit("PROMO"))
    expression = F.concat("p_brand", F.lit(" "), kind, F.lit(" "), "p_name", F.lit(" "))
    return T.combine_columns(part, expression, "full_name").select("p_partkey", "p_name", "p_brand", "full_name")


@query("t06_concatenate_tables", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def concatenate_tables(spark, sf):
    lines = table(spark, sf, "lineitem")
    splits = [lines.filter(F.col("l_returnflag") == flag) for flag in ("N", "A", "R")]
    return T.concatenate_tables(["l_orderkey", "l_linenumber", "l_returnflag"], *splits)


_TARGET_SQL = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS custkey FROM orders"


def _delete_target(spark, sf):
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", key.alias("custkey"))


@query(
    "t07_delete_rows_not_in",
    f"""SELECT * FROM ({_TARGET_SQL}) t WHERE (custkey NOT IN
        (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) IS NOT TRUE""",
)
def delete_rows_not_in(spark, sf):
    source = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return T.delete_rows_not_in(_delete_target(spark, sf), source, "custkey", "c_custkey")


@query(
    "t07_delete_null_in_source",
    f"""SELECT * FROM ({_TARGET_SQL}) t WHERE (custkey NOT IN
        (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END FROM customer)) IS NOT TRUE""",
)
def delete_null_in_source(spark, sf):
    key = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))
    source = table(spark, sf, "customer").select(key.alias("c_custkey"))
    return T.delete_rows_not_in(_delete_target(spark, sf), source, "custkey", "c_custkey")


@query(
    "t07_delete_empty_source",
    f"""SELECT * FROM ({_TARGET_SQL}) t WHERE (custkey NOT IN
        (SELECT c_custkey FROM customer WHERE c_mktsegment = 'NO SUCH SEGMENT')) IS NOT TRUE""",
)
def delete_empty_source(spark, sf):
    source = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "NO SUCH SEGMENT")
    return T.delete_rows_not_in(_delete_target(spark, sf), source, "custkey", "c_custkey")


@query(
    "t08_j3_update_table_columns",
    """WITH s AS (SELECT CASE WHEN l_partkey % 3 > 0 THEN l_partkey END AS l_partkey, nullif(max(l_discount), 0.1) AS d
                  FROM lineitem GROUP BY 1)
       SELECT p_partkey, CASE WHEN s.l_partkey IS NOT NULL THEN s.d ELSE p_retailprice END AS p_retailprice
       FROM part LEFT JOIN s ON l_partkey = p_partkey""",
)
def update_table_columns(spark, sf):
    """Every third part has no source row."""
    key = F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("l_partkey")
    source = table(spark, sf, "lineitem").groupBy(key).agg(F.nullif(F.max("l_discount"), F.lit(0.1)).alias("d"))
    target = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return T.update_table_columns(target, source, "p_retailprice", "d", "p_partkey", "l_partkey")


@query(
    "t08_update_on_two_keys",
    """WITH s AS (SELECT p_brand, p_type, max(p_name) AS name FROM part GROUP BY p_brand, p_type HAVING max(p_name) < 'n')
       SELECT p_partkey, part.p_brand, part.p_type,
              CASE WHEN s.p_brand IS NOT NULL THEN s.name ELSE p_name END AS p_name
       FROM part LEFT JOIN s ON part.p_brand = s.p_brand AND part.p_type = s.p_type""",
)
def update_on_two_keys(spark, sf):
    part = table(spark, sf, "part")
    source = part.groupBy("p_brand", "p_type").agg(F.max("p_name").alias("name")).filter("name < 'n'")
    source = source.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "name")
    target = part.select("p_partkey", "p_brand", "p_type", "p_name")
    return T.update_table_columns(target, source, "p_name", "name", ["p_brand", "p_type"], ["brand", "type"])


@query(
    "t07_delete_mixed_key_types",
    """SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN
       (SELECT CAST(c_custkey % 20 AS BIGINT) FROM customer)""",
)
def delete_mixed_key_types(spark, sf):
    """Int keys against bigint keys: equal values stay."""
    target = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    source = table(spark, sf, "customer").select((F.col("c_custkey") % 20).cast("long").alias("key"))
    return T.delete_rows_not_in(target, source, "n_nationkey", "key").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query(
    "t08_update_mixed_key_types",
    """WITH s AS (SELECT c_nationkey, max(c_name) AS c FROM customer GROUP BY c_nationkey)
       SELECT n_nationkey, coalesce(c, n_name) AS n_name FROM nation LEFT JOIN s ON c_nationkey = n_nationkey""",
)
def update_mixed_key_types(spark, sf):
    target = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    source = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("key")).agg(F.max("c_name").alias("c"))
    return T.update_table_columns(target, source, "n_name", "c", "n_nationkey", "key")


@query(
    "t09_j2_merge_table_columns",
    "SELECT c_custkey, c_name, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def merge_table_columns(spark, sf):
    return T.merge_table_columns(
        table(spark, sf, "customer"),
        table(spark, sf, "nation"),
        ["c_custkey", "c_name"],
        ["n_name", "n_regionkey"],
        "c_nationkey",
        "n_nationkey",
    )


@query(
    "t10_left_merge_predictions",
    """WITH items AS (SELECT p_partkey AS row_idx, p_brand || ' ' || nullif(p_name, 'hot gear') AS product_name, p_size FROM part),
            preds AS (SELECT p_partkey AS row_idx, nullif(p_brand, 'Brand#7') || ' ' || p_name AS product_name, p_type AS pred FROM part),
            j AS (SELECT i.row_idx, i.product_name, i.p_size, p.pred,
                         row_number() OVER (PARTITION BY i.product_name ORDER BY i.row_idx, p.row_idx) AS rn
                  FROM items i LEFT JOIN preds p ON i.product_name IS NOT DISTINCT FROM p.product_name)
       SELECT row_idx, product_name, p_size, pred FROM j WHERE rn = 1""",
)
def left_merge_predictions(spark, sf):
    part = table(spark, sf, "part")
    items = part.select(
        F.col("p_partkey").alias("row_idx"),
        F.concat("p_brand", F.lit(" "), F.nullif("p_name", F.lit("hot gear"))).alias("product_name"),
        "p_size",
    )
    predictions = part.select(
        F.col("p_partkey").alias("row_idx"),
        F.concat(F.nullif("p_brand", F.lit("Brand#7")), F.lit(" "), "p_name").alias("product_name"),
        F.col("p_type").alias("pred"),
    )
    return T.left_merge_predictions(items, predictions)


@query(
    "t11_split_dataset",
    """WITH l AS (SELECT doc_id, lang, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE lang <> 'es')
       SELECT doc_id, lang AS class, row_number() OVER (ORDER BY h) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM l""",
)
def split_dataset(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("class"))
    return T.split_dataset(docs, "doc_id")


@query("t12_count_table_rows", "SELECT CAST(count(nullif(source, 'src3')) AS BIGINT) AS n_rows FROM documents")
def count_table_rows(spark, sf):
    docs = table(spark, sf, "documents").select(F.nullif("source", F.lit("src3")).alias("source"))
    return T.count_table_rows(docs, "source")


# --- grouping and numbering ---------------------------------------------------------------------------


@query(
    "a01_drop_duplicates",
    """SELECT doc_id, lang, source FROM
         (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) t WHERE rn = 1""",
)
def drop_duplicates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return G.drop_duplicates(docs, "text", "doc_id").drop("text")


@query(
    "a01_drop_duplicates_in_turn",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents),
            b AS (SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS rn2 FROM a WHERE rn = 1)
       SELECT doc_id, n_chars FROM b WHERE rn2 = 1""",
)
def drop_duplicates_in_turn(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    return G.drop_duplicates(docs, ["text", "n_chars"], "doc_id").drop("text")


@query(
    "a02_renumber_ids",
    """SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS new_id, o_orderkey, o_totalprice FROM orders""",
)
def renumber_ids(spark, sf):
    return G.renumber_ids(
        table(spark, sf, "orders"), "new_id", ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"]
    )


@query(
    "a02_renumber_few_values",
    """SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS o_orderkey, o_custkey, o_orderpriority FROM orders""",
)
def renumber_few_values(spark, sf):
    return G.renumber_ids(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", ["o_custkey", "o_orderpriority"])


@query(
    "a03_class_table",
    """SELECT row_number() OVER (ORDER BY class_name) - 1 AS id, class_name
       FROM (SELECT DISTINCT source AS class_name FROM documents) t""",
)
def class_table(spark, sf):
    return G.class_table(table(spark, sf, "documents"), "source")


@query(
    "a04_unique_table",
    "SELECT min(p_partkey) AS p_partkey, p_type, p_brand, p_name FROM part GROUP BY p_type, p_brand, p_name",
)
def unique_table(spark, sf):
    keys = ["p_type", "p_brand", "p_name"]
    return G.unique_table(table(spark, sf, "part"), "p_partkey", keys, keys)


TAXONOMY_SQL = """gpc AS (SELECT p_partkey AS row_idx, nullif(p_type, 'PROMO') AS SegmentTitle, p_brand AS FamilyTitle,
                         nullif(p_name, 'hot gear') AS ClassTitle FROM part)"""


@query(
    "a05_first_per_class",
    f"""WITH {TAXONOMY_SQL}
        SELECT ClassTitle, min_by(SegmentTitle, row_idx) FILTER (WHERE SegmentTitle IS NOT NULL) AS SegmentTitle,
               min_by(FamilyTitle, row_idx) FILTER (WHERE FamilyTitle IS NOT NULL) AS FamilyTitle
        FROM gpc WHERE ClassTitle IS NOT NULL GROUP BY ClassTitle""",
)
def first_per_class(spark, sf):
    return G.first_per_class(inputs.taxonomy(spark, sf))


@query(
    "a06_extract_labels",
    f"""WITH {TAXONOMY_SQL},
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ClassTitle ORDER BY row_idx) AS rn FROM gpc
                             WHERE ClassTitle IS NOT NULL) z WHERE rn = 1)
        SELECT p_partkey AS item_id, p_name AS class, SegmentTitle AS pred_segment, FamilyTitle AS pred_family,
               f.ClassTitle IS NOT NULL AS in_taxonomy
        FROM part LEFT JOIN f ON f.ClassTitle = p_name""",
)
def extract_labels(spark, sf):
    rows = inputs.items(spark, sf).select("item_id", "class")
    return G.extract_labels(rows, inputs.taxonomy(spark, sf), "class")


@query(
    "a07_distinct_children",
    f"""WITH {TAXONOMY_SQL}
        SELECT SegmentTitle, FamilyTitle, min(row_idx) AS row_idx FROM gpc
        WHERE SegmentTitle IS NOT NULL GROUP BY SegmentTitle, FamilyTitle""",
)
def distinct_children(spark, sf):
    return G.distinct_children(inputs.taxonomy(spark, sf), "SegmentTitle", "FamilyTitle")


@query(
    "a07_distinct_titles",
    f"""WITH {TAXONOMY_SQL}
        SELECT ClassTitle, min(row_idx) AS row_idx FROM gpc WHERE ClassTitle IS NOT NULL GROUP BY ClassTitle""",
)
def distinct_titles(spark, sf):
    return G.distinct_titles(inputs.taxonomy(spark, sf), "ClassTitle")


# --- text columns -------------------------------------------------------------------------------------


@query(
    "x01_cleanse",
    r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               text, '[[:digit:]]+', '', 'g'), '[-_/\\|]', ' ', 'g'), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g'))) AS text
        FROM documents""",
)
def cleanse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.cleanse(F.col("text")).alias("text"))


@query(
    "x02_unicode_clean",
    r"""SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\p{C}', '', 'g')) AS text FROM documents""",
)
def unicode_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.unicode_clean(F.col("text")).alias("text"))


@query(
    "x03_product_document",
    "SELECT p_partkey, p_type || ' ' || nullif(p_brand, 'Brand#7') || ' ' || p_name AS document FROM part",
)
def product_document(spark, sf):
    brand = F.nullif("p_brand", F.lit("Brand#7"))
    return table(spark, sf, "part").select("p_partkey", X.product_document("p_type", brand, "p_name").alias("document"))


@query(
    "x04_confidence_level",
    """SELECT l_orderkey, l_linenumber, CASE WHEN r * 100 BETWEEN 0 AND 50 THEN 'Low' WHEN r * 100 > 50 AND r * 100 <= 75 THEN 'Medium'
              WHEN r * 100 > 75 AND r * 100 <= 100 THEN 'High' END AS level
       FROM (SELECT l_orderkey, l_linenumber, l_quantity / 40.0e0 AS r FROM lineitem) t""",
)
def confidence_level(spark, sf):
    rate = F.col("l_quantity") / F.lit(40.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.confidence_level(rate).alias("level"))
