"""CSV queries: a table is written as CSV to the shared folder, problems included, and read back as a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import delimited as de
from ..sources import entities as en
from ..sources import tables as tb
from .canonical import Tables
from .registry import query, rounded

HEADER = ["OrderKey", "OrderDate", "Status", "Units", "UnitPrice"]


def _write_lines(t: Tables, cells: list, header: list[str], short, name: str) -> str:
    """Write comma-separated lines under a header; lines where ``short`` holds lose their last cell."""
    line = F.concat_ws(",", *cells[:-1], F.when(~short, cells[-1]))
    path = shared_folder(t.spark, name)
    rows = t("orders").select(line.alias(",".join(header)))
    # one raw text column: a separator that never occurs, and no quoting
    rows.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return path


def _orders_file(t: Tables) -> str:
    """Orders as CSV: every 50th line short, every 33rd date unreadable, every 21st quantity blank, every 13th price text."""
    k = F.col("o_orderkey")
    cells = [
        k.cast("string"), F.when(k % 33 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.col("o_orderstatus"),
        F.when(k % 21 == 0, "").otherwise((k % 9 + 1).cast("string")), F.when(k % 13 == 0, "free").otherwise(F.format_string("%.2f", "o_totalprice")),
    ]
    return _write_lines(t, cells, HEADER, k % 50 == 0, "orders-csv")


SCHEMA = de.Schema((de.ColumnSpec("OrderKey", "id"), de.ColumnSpec("OrderDate", "time"), de.ColumnSpec("Status", "category"), de.ColumnSpec("Units", "integer"),
                    de.ColumnSpec("UnitPrice", "real")), {"time": "OrderDate", "quantity": "Units", "price": "UnitPrice"})


@query("a01_csv_scan", """select cast(o_orderkey as varchar) as OrderKey, cast(cast(o_orderdate as date) as varchar) as OrderDate, o_orderstatus as Status, o_orderkey % 9 + 1 as Units,
  case when o_orderkey % 13 <> 0 then o_totalprice end as UnitPrice from orders where o_orderkey % 50 <> 0 and o_orderkey % 33 <> 0 and o_orderkey % 21 <> 0""")
def _(t: Tables):
    rows = de.scan(t.spark, _orders_file(t), SCHEMA)
    return rows.withColumn("OrderDate", F.date_format("OrderDate", "yyyy-MM-dd"))


@query("a02_csv_audit", """with f as (select o_orderkey as k, cast(o_orderdate as date) as d from orders), w as (select * from f where k % 50 <> 0)
  select (select count(*) from f) as rows_read, count(*) filter (k % 33 <> 0 and k % 21 <> 0) as rows_kept, (select count(*) from f where k % 50 = 0) as malformed, count(*) filter (k % 33 = 0 or k % 21 = 0) as unusable,
  count(*) filter (k % 33 = 0) as bad_dates, count(*) filter (k % 13 = 0) as bad_prices, count(*) filter (k % 21 = 0) as blank_units, cast(min(d) filter (k % 33 <> 0) as varchar) as first_date,
  cast(max(d) filter (k % 33 <> 0) as varchar) as last_date from w""")
def _(t: Tables):
    a = de.audit(t.spark, _orders_file(t), SCHEMA)
    row = (a["rows_read"], a["rows_kept"], a["skipped"]["malformed rows"], a["skipped"]["rows without a readable time or quantity"], a["unreadable"]["OrderDate"],
           a["unreadable"]["UnitPrice"], a["blank"]["Units"], a["first_date"], a["last_date"])
    return t.spark.createDataFrame([row], "rows_read bigint, rows_kept bigint, malformed bigint, unusable bigint, bad_dates bigint, bad_prices bigint, blank_units bigint, first_date string, last_date string")


@query("a03_infer_schema", """select unnest(['OrderKey', 'OrderDate', 'Status', 'Units', 'UnitPrice']) as name, unnest(['id', 'time', 'category', 'integer', 'real']) as kind, unnest([null, 'time', null, 'quantity', 'price']) as role""")
def _(t: Tables):
    k = F.col("o_orderkey")
    cells = [k.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus"), (k % 9 + 1).cast("string"), F.format_string("%.2f", "o_totalprice")]
    found = de.infer_schema(t.spark, _write_lines(t, cells, HEADER, F.lit(False), "clean-csv"))
    roles = {c: r for r, c in found.roles.items()}
    return t.spark.createDataFrame([(c.name, c.kind, roles.get(c.name)) for c in found.columns], "name string, kind string, role string")


RETAIL = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price"]


def _retail_file(t: Tables) -> str:
    k = F.col("o_orderkey")
    cells = [
        k.cast("string"), F.when(k % 40 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("o_custkey") % 97).cast("string"))), F.lit("thing"),
        F.when(k % 17 == 0, "many").when(k % 11 == 0, "0").when(k % 7 == 0, F.concat(F.lit("-"), (k % 5 + 1).cast("string"))).otherwise((k % 5 + 1).cast("string")),
        F.when(k % 29 == 0, "later").otherwise(F.date_format("o_orderdate", "M/d/yy H:mm")), F.when(k % 31 == 0, "-1").otherwise(F.format_string("%.2f", "o_totalprice")),
    ]
    return _write_lines(t, cells, RETAIL, F.lit(False), "retail-csv")


REASONS = """reasons as (select *, case when o_orderkey % 40 = 0 then 'missing StockCode' when o_orderkey % 17 = 0 then 'non-numeric Quantity or Price' when o_orderkey % 11 = 0 then 'zero Quantity'
  when o_orderkey % 29 = 0 then 'unparseable InvoiceDate' when o_orderkey % 31 = 0 then 'invalid_record' end as reason from orders)"""


@query("a05_retail_report", f"with {REASONS} select coalesce(reason, 'kept') as reason, count(*) as n from reasons group by 1")
def _(t: Tables):
    report = en.read_retail(t.spark, _retail_file(t))[2]
    return report.select(F.coalesce("skip_reason", F.lit("kept")).alias("reason"), "n")


@query("a05_retail_orders", f"""with {REASONS} select 'C' || cast(o_custkey % 97 as varchar) as sku_id, cast(cast(o_orderdate as date) as varchar) as day, o_orderkey % 5 + 1 as quantity,
  case when o_orderkey % 7 = 0 then 'cancelled' else 'shipped' end as status, count(*) as n from reasons where reason is null group by 1, 2, 3, 4""")
def _(t: Tables):
    orders = en.read_retail(t.spark, _retail_file(t))[1]
    return orders.groupBy("sku_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "quantity", "status").agg(F.count(F.lit(1)).alias("n"))


@query("a12_csv_round_trip", "select o_orderkey, '''=' || o_orderpriority as note, o_totalprice from orders")
def _(t: Tables):
    path = shared_folder(t.spark, "export-csv")
    tb.write_csv(t("orders").select("o_orderkey", F.concat(F.lit("="), "o_orderpriority").alias("note"), "o_totalprice"), path)
    return rounded(t.spark.read.option("header", True).schema("o_orderkey bigint, note string, o_totalprice double").csv(path))
