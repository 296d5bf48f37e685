"""CSV reading, auditing, inference and the retail layout on small files."""

from datetime import date, datetime

import random

import pytest
from pyspark.sql import functions as F

from stockwright.functions.times import INFER_FORMATS, time_value
from stockwright.sources import delimited as de, entities as en, tables as tb


def write(tmp_path, text, name="s.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def sales(n=40):
    rows = ["OrderDate,Sku,Units,UnitPrice"]
    rows += [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d},S{i % 4},{i % 7 + 1},{2.5 + i % 4}" for i in range(n)]
    return "\n".join(rows) + "\n"


def test_inferred_schema_of_a_sales_file(spark, tmp_path):
    schema = de.infer_schema(spark, write(tmp_path, sales()))
    assert [(c.name, c.kind) for c in schema.columns] == [("OrderDate", "time"), ("Sku", "category"), ("Units", "integer"), ("UnitPrice", "real")]
    assert schema.roles == {"time": "OrderDate", "item": "Sku", "quantity": "Units", "price": "UnitPrice"}
    assert (schema.delimiter, schema.decimal) == (",", ".")


def test_scan_and_audit_count_every_row(spark, tmp_path):
    text = sales(40) + "2024-03-01,S1\n\nnot a date,S1,3,1.0\n2024-03-02,S1,,1.0\n2024-03-03,S1,2,x\n2024-03-04,S2,3.0,1,extra\n"
    path = write(tmp_path, text)
    schema = de.infer_schema(spark, write(tmp_path, sales(), "clean.csv"))
    report = de.audit(spark, path, schema)
    assert report["rows_read"] == 45 and report["rows_kept"] == 41
    assert report["skipped"] == {"malformed rows": 2, "rows without a readable time or quantity": 2}
    assert report["unreadable"] == {"OrderDate": 1, "UnitPrice": 1} and report["blank"] == {"Units": 1}
    assert report["examples"]["OrderDate"] == ["not a date"]
    assert (report["first_date"], report["last_date"]) == ("2024-01-01", "2024-03-03")
    rows = de.scan(spark, path, schema)
    assert rows.count() == 41 and rows.where("UnitPrice is null").count() == 1


def test_audit_refuses_other_columns_and_unreadable_quantities(spark, tmp_path):
    schema = de.infer_schema(spark, write(tmp_path, sales()))
    with pytest.raises(ValueError, match="columns differ"):
        de.audit(spark, write(tmp_path, "A,B\n1,2\n", "other.csv"), schema)
    bad = "OrderDate,Sku,Units,UnitPrice\n" + "2024-01-01,S,many,1\n" * 3 + "2024-01-01,S,2,1\n" * 7
    with pytest.raises(ValueError, match="column Units: 3 of 10"):
        de.audit(spark, write(tmp_path, bad, "bad.csv"), schema)


def test_semicolon_and_decimal_comma(spark, tmp_path):
    schema = de.infer_schema(spark, write(tmp_path, "Date;Item;Qty;Price\n" + "\n".join(f"2024-01-{i:02d};a{i % 3};{i};{i},50" for i in range(1, 25))))
    assert (schema.delimiter, schema.decimal) == (";", ",")
    assert schema.column("Price").kind == "real"


def test_ambiguous_dates_must_be_settled(spark, tmp_path):
    path = write(tmp_path, "Date,Item,Qty\n03/04/2024,a,1\n05/06/2024,a,2\n")
    schema = de.infer_schema(spark, path)
    assert schema.column("Date").ambiguous
    with pytest.raises(ValueError, match="ambiguous"):
        de.scan(spark, path, schema)
    day_first = de.scan(spark, path, schema.settled("Date", "d/M/yyyy")).orderBy("Qty").collect()
    assert day_first[0].Date == datetime(2024, 4, 3)


def test_kind_rules(spark, tmp_path):
    head = "Customer ID,Note,Code,Empty,Serial\n"
    body = "".join(f"{i},{'some long remark that goes on and on for ever ' + str(i)},x,,{1000 + i}\n" for i in range(30))
    kinds = {c.name: c.kind for c in de.infer_schema(spark, write(tmp_path, head + body)).columns}
    assert kinds == {"Customer ID": "id", "Note": "text", "Code": "id", "Empty": "category", "Serial": "id"}
    assert de.field_name("InvoiceDate") == "invoice_date" and de.field_name("2nd") == "c_2_nd"


@pytest.mark.parametrize("text,pattern,want", [
    ("12/1/10 8:26", "M/d/yy H:m", datetime(2010, 12, 1, 8, 26)),
    ("3/4/2011", "M/d/yyyy", datetime(2011, 3, 4)),
    ("3/4/85", "M/d/yy", datetime(1985, 3, 4)),
    ("31/12/2020 23:59", "d/M/yyyy H:m", datetime(2020, 12, 31, 23, 59)),
    ("2020-01-02 03:04:05", "yyyy-M-d H:m:s", datetime(2020, 1, 2, 3, 4, 5)),
    ("13/13/2020", "M/d/yyyy", None), ("1/2/20", "M/d/yyyy", None), ("1/2/2020", "M/d/yy", None),
])
def test_time_formats(spark, text, pattern, want):
    assert pattern in INFER_FORMATS
    got = spark.createDataFrame([(text,)], "t string").select(time_value(F.col("t"), [pattern])).first()[0]
    assert got == want


def test_iso_times_drop_the_offset(spark):
    rows = [("2024-01-02",), ("2024-01-02T03:04",), ("2024-01-02 03:04:05.5",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04Z",), ("2024-1-2",), ("2024-02-30",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(time_value(F.col("t"))).collect()]
    assert got[0] == datetime(2024, 1, 2) and got[1] == datetime(2024, 1, 2, 3, 4) and got[3] == datetime(2024, 1, 2, 3, 4, 5)
    assert got[4] == datetime(2024, 1, 2, 3, 4) and got[5] is None and got[6] is None


def test_numbers(spark):
    rows = [("1.5",), ("1d",), ("inf",), ("1_000",), ("-3",), ("3.0",), ("1e3",), ("1,5",), ("1.234",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(de.number(F.col("t"))).collect()]
    assert got == [1.5, None, None, None, -3.0, 3.0, 1000.0, None, 1.234]
    comma = [r[0] for r in df.select(de.number(F.col("t"), ",")).collect()]
    assert comma[7] == 1.5 and comma[8] is None
    whole = [r[0] for r in df.select(de.whole_number(F.col("t"))).collect()]
    assert whole[0] is None and whole[4] == -3 and whole[5] == 3 and whole[6] == 1000


def test_retail_file(spark, tmp_path):
    text = ("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
            "1,A,first name,6,12/1/10 8:26,2.55,9,UK\n2,A,other,-2,12/1/10 9:00,3.00,9,UK\n3,,x,1,12/1/10 9:00,1,9,UK\n4,B,b,zero,12/1/10 9:00,1,9,UK\n"
            "5,B,b,0,12/1/10 9:00,1,9,UK\n6,B,b,1,soon,1,9,UK\n7,B,b,1,12/1/10 9:00,-1,9,UK\n")
    skus, orders, report = en.read_retail(spark, write(tmp_path, text))
    assert {r.skip_reason: r.n for r in report.collect()} == {
        None: 2, "missing StockCode": 1, "non-numeric Quantity or Price": 1, "zero Quantity": 1, "unparseable InvoiceDate": 1, "invalid_record": 1}
    assert [(r.sku_id, r.name, r.unit_price, r.unit_cost) for r in skus.collect()] == [("A", "first name", 2.55, 1.53)]
    assert sorted((r.quantity, r.status) for r in orders.collect()) == [(2, "cancelled"), (6, "shipped")]


def test_csv_export_guards_formulas(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 3, {"a": 1}), ("fine", -2, None)], "t string, n int, m map<string,int>")
    safe = tb.csv_safe(df).orderBy("n").collect()
    assert [r.t for r in safe] == ["fine", "'=1+1"] and safe[1].m == '{"a":1}' and safe[0].n == -2
    tb.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_contract_and_catalog(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("b", "2024-1-1", float("inf"))], "k string, d string, v double")
    fields = [tb.Field("k", "dimension"), tb.Field("d", "time"), tb.Field("v", "measure")]
    assert {r.field: r.violations for r in tb.contract_violations(df, fields).collect()} == {"k": 0, "d": 1, "v": 1}
    assert tb.described(df, fields).schema["v"].metadata["aggregate"] == "sum"
    with pytest.raises(ValueError, match="does not go with kind dimension"):
        tb.Field("k", "dimension", unit="x")
    book = tb.Catalog()
    book.register("one", "sku", "files", df)
    with pytest.raises(ValueError, match="exists"):
        book.register("one", "sku", "files", df)
    rows, more = tb.read_at_most(df, 1)
    assert rows.count() == 1 and more


def test_sample_is_the_same_under_any_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in tb.hash_sample(df.repartition(1), 50, 3, ["k"]).collect()}
    b = {r.k for r in tb.hash_sample(df.repartition(8), 50, 3, ["k"]).collect()}
    assert a == b and len(a) == 50


def test_entity_checks_name_the_first_problem(spark):
    df = spark.createDataFrame([("", "L", -1, 0, 0), ("s", "L", 1, 0, 0)], "sku_id string, location_id string, on_hand int, reserved int, in_transit int")
    good, bad = en.split_checked(df, "inventory")
    assert good.count() == 1 and bad.first().problem == "sku_id: must be a non-empty string"
    assert len(bad.first().violations) == 2


def test_cells_across_lines_and_splits(spark, tmp_path):
    """A table with quotes, delimiters and line breaks in its cells comes back whole, however the file is split."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(['a', '"', ",", "\n", "x y", "\r\n", "é"]) for _ in range(rng.randrange(12))) + "z") for i in range(400)]
    folder = tmp_path / "parts"
    folder.mkdir()
    for part in range(2):
        lines = ["n,note"] + [f'{i},"{t.replace(chr(34), chr(34) * 2)}"' for i, t in rows[part * 200 : part * 200 + 200]]
        (folder / f"{part}.csv").write_bytes("\n".join([*lines, ""]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    schema = de.Schema((de.ColumnSpec("n", "integer"), de.ColumnSpec("note", "text")))
    try:
        for size in ("97b", "1000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(tuple(r) for r in de.scan(spark, str(folder), schema).collect()) == [(i, t.strip(" ")) for i, t in rows]
        assert de.audit(spark, str(folder), schema)["rows_read"] == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_row_in_file_order_names_the_item(spark, tmp_path):
    head = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country"
    folder = tmp_path / "retail"
    folder.mkdir()
    for part, name in enumerate(["first\nof all", "second", "third"]):
        rows = "".join(f'{part}{k},A,"{name} {k}",1,2010-12-01 08:2{k}:00,2.5,1,UK\n' for k in range(5))
        (folder / f"{part}.csv").write_text(f"{head}\n{rows}")
    skus, orders, _ = en.read_retail(spark, str(folder))
    assert [r.name for r in skus.collect()] == ["first\nof all 0"]
    assert orders.count() == orders.select("order_id").distinct().count() == 15
