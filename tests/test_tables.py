"""Table rewrites on rows that the given tables lack."""

import pytest
from row_helpers import rows
from pyspark.sql import functions as F

from tierlabel.operators import groups as G
from tierlabel.operators import tables as T
from tierlabel.sources import tables as S


def frame(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_unknown_file_type(spark):
    with pytest.raises(ValueError):
        S.read_table(spark, "/nowhere/table.txt")


def test_workbook_folder(spark, tmp_path, small):
    from tierlabel.plans.inputs import write_workbooks
    from tierlabel.plans.table_queries import CUSTOMER_SCHEMA

    customers = spark.read.parquet(f"{small}/customer.parquet").repartition(3)
    paths = [r.path for r in write_workbooks(customers, str(tmp_path)).collect()]
    assert rows(S.read_table(spark, paths[0], CUSTOMER_SCHEMA)) != []
    read = S.read_workbooks(spark, str(tmp_path), CUSTOMER_SCHEMA)
    assert rows(read) == rows(customers)


def test_workbook_with_shared_strings_gaps_and_second_sheet(spark, tmp_path):
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="a" sheetId="7" r:id="rId9"/>'
        '<sheet name="b" sheetId="8" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="/xl/worksheets/first.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>name</t></si><si><t>size</t></si><si><r><t>red </t></r><r><t>ring</t></r></si></sst>',
        "xl/worksheets/first.xml": f'<worksheet xmlns="{main}"><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="C2"><v>4.5</v></c></row>'
        '<row r="3"><c r="C3"><v>6</v></c></row></sheetData></worksheet>',
        "xl/worksheets/other.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
    }
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        for name, content in parts.items():
            book.writestr(name, content)
    got = S.read_table(spark, str(tmp_path / "book.xlsx"), "size double, name string, absent int")
    assert rows(got) == [(4.5, "red ring", None), (6.0, None, None)]


def test_insert_modes(spark, small):
    name = "insert_modes"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    nation = spark.read.parquet(f"{small}/nation.parquet")
    S.insert_table(nation, name)
    S.insert_table(nation, name)
    assert S.get_table(spark, name).count() == nation.count()
    with pytest.raises(Exception, match="already exists"):
        S.insert_table(nation, name, "fail")
    with pytest.raises(ValueError):
        S.insert_table(nation, name, "other")
    S.drop_table(spark, name)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        S.drop_table(spark, name)


def test_row_index_rises_in_file_order(spark, small):
    indexed = S.with_row_index(spark.read.parquet(f"{small}/part.parquet"))
    keys = [r.p_partkey for r in indexed.orderBy("row_idx").collect()]
    assert keys == sorted(keys)


def test_row_index_over_files_of_unequal_size(spark, tmp_path):
    spark.range(1).write.csv(f"{tmp_path}/a.csv")
    spark.range(1, 1999).repartition(3).sortWithinPartitions("id").write.csv(f"{tmp_path}/b.csv")
    files = spark.read.schema("id long").csv([f"{tmp_path}/b.csv", f"{tmp_path}/a.csv"])
    indexed = S.with_row_index(files).orderBy("row_idx").collect()
    assert [r.row_idx for r in indexed] == list(range(1999)) and indexed[0].id == 0


@pytest.mark.parametrize(
    ("a", "b", "value"),
    [("int", "bigint", "7"), ("smallint", "int", "7"), ("date", "timestamp", "'2020-01-02'"), ("decimal(5,1)", "decimal(9,3)", "1.5"), ("int", "decimal(9,2)", "7")],
)
def test_keys_of_different_types_match(spark, a, b, value):
    target = spark.sql(f"SELECT CAST({value} AS {a}) AS k, 'old' AS v UNION ALL SELECT NULL, 'kept'")
    source = spark.sql(f"SELECT CAST({value} AS {b}) AS s, 'new' AS w")
    assert sorted(r.v for r in T.update_table_columns(target, source, "v", "w", "k", "s").collect()) == ["kept", "new"]
    assert sorted(r.v for r in T.delete_rows_not_in(target, source, "k", "s").collect()) == ["kept", "old"]


def test_keys_without_a_common_type(spark):
    with pytest.raises(TypeError):
        T.delete_rows_not_in(frame(spark, "k int", (1,)), frame(spark, "s string", ("1",)), "k", "s")


def test_sample_without_key(spark, small):
    assert S.sample_rows(spark.read.parquet(f"{small}/part.parquet")).count() == 3


def test_drop_missing_column(spark):
    with pytest.raises(ValueError):
        T.drop_column(frame(spark, "a int", (1,)), "b")


@pytest.mark.parametrize(
    "target, source, left",
    [
        ([1, 2, None], [1], [1, None]),
        ([1, 2, None], [1, None], [1, 2, None]),
        ([1, 2, None], [None], [1, 2, None]),
        ([1, 2, None], [], []),
        ([1, 1, 2], [1, 1], [1, 1]),
    ],
)
def test_delete_rows_not_in(spark, target, source, left):
    t = frame(spark, "k int", *[(v,) for v in target])
    s = frame(spark, "s int", *[(v,) for v in source])
    assert rows(T.delete_rows_not_in(t, s, "k", "s")) == sorted([(v,) for v in left], key=repr)


def test_update_overwrites_with_null_and_keeps_unmatched(spark):
    t = frame(spark, "k int, v string", (1, "a"), (2, "b"), (3, "c"), (None, "d"))
    s = frame(spark, "k2 int, w string", (1, None), (2, "B"), (None, "x"), (9, "y"))
    got = T.update_table_columns(t, s, "v", "w", "k", "k2")
    assert rows(got) == sorted([(1, None), (2, "B"), (3, "c"), (None, "d")], key=repr)


def test_update_with_duplicate_source_key_fails(spark):
    t = frame(spark, "k int, v string", (1, "a"))
    s = frame(spark, "k2 int, w string", (1, "x"), (1, "y"))
    with pytest.raises(Exception, match="more than one source row"):
        T.update_table_columns(t, s, "v", "w", "k", "k2").collect()


def test_combine_is_null_with_a_null_operand(spark):
    df = frame(spark, "a string, b string", ("x ", "y "), ("x", None))
    got = T.combine_columns(df, F.concat("a", "b"), "c").select("c")
    assert rows(got) == sorted([("x y",), (None,)], key=repr)


def test_concatenate_only_what_is_there(spark):
    a, b = frame(spark, "x int, y int", (1, 2)), frame(spark, "y int, x int", (3, 4))
    assert rows(T.concatenate_tables(["x"], a)) == [(1,)]
    assert rows(T.concatenate_tables(["x", "y"], a, None, b)) == [(1, 2), (4, 3)]


def test_drop_duplicates_in_turn_and_nulls(spark):
    df = frame(spark, "id int, a string, b string", (1, "p", "q"), (2, "p", "r"), (3, None, "q"), (4, None, "s"), (5, "z", "t"))
    assert rows(G.drop_duplicates(df, ["a", "b"])) == [(1, "p", "q"), (5, "z", "t")]
    assert [r[0] for r in rows(G.drop_duplicates(df, "a"))] == [1, 3, 5]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_renumber_gives_one_to_n(spark, small, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        orders = spark.read.parquet(f"{small}/orders.parquet")
        got = G.renumber_ids(orders, "new_id", ["o_orderpriority", "o_orderkey"], ["o_orderkey", "o_orderpriority"])
        got = got.orderBy("new_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [r.new_id for r in got] == list(range(1, orders.count() + 1))
    keys = [(r.o_orderpriority, r.o_orderkey) for r in got]
    assert keys == sorted(keys)


def test_first_per_class_differs_from_first_row(spark):
    df = frame(
        spark,
        "row_idx long, SegmentTitle string, FamilyTitle string, ClassTitle string",
        (0, None, "f0", "c"),
        (1, "s1", "f1", "c"),
    )
    assert rows(G.first_per_class(df)) == [("c", "s1", "f0")]
    assert rows(G.first_row_per_class(df)) == [("c", None, "f0")]


def test_extract_labels_of_unknown_class(spark):
    gpc = frame(spark, "row_idx long, SegmentTitle string, FamilyTitle string, ClassTitle string", (0, "s", "f", "c"))
    got = G.extract_labels(frame(spark, "k string", ("c",), ("x",), (None,)), gpc, "k")
    assert rows(got) == sorted([("c", "s", "f", True), ("x", None, None, False), (None, None, None, False)], key=repr)


@pytest.mark.parametrize("n", [1, 2, 10, 23])
def test_split_sizes(spark, n):
    df = spark.range(n).select("id", F.lit("a").alias("class"))
    split = T.split_dataset(df, "id")
    assert split.count() == n
    assert split.filter("is_test").count() == -(-n // 5)


def test_split_is_cut_once_for_both_sides(spark):
    split = T.split_dataset(spark.range(50).select("id", F.lit("a").alias("class")), "id")
    assert "Subquery" not in split._jdf.queryExecution().executedPlan().toString()


def test_split_of_nothing(spark):
    assert T.split_dataset(spark.range(0).select("id", F.lit("a").alias("class")), "id").count() == 0
