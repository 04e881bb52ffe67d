"""Round trips through files, run history, nested results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ...operators import kpi, profile
from ...session import scratch_path, write_once
from ...sources import readers, sinks
from ..analysis import report_sections
from ..facts import orders_fact, sales, table
from .kpis import BASE_SQL, CHURN_SQL
from .registry import query, with_orders, with_sales

ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"""


def _orders(spark, folder):
    return table(spark, folder, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query(ORDERS_SQL)
def roundtrip_csv(spark, folder):
    path = scratch_path(spark, "orders-csv") + ".csv"
    sinks.write_csv(_orders(spark, folder), path)
    return readers.read_dataset(spark, path)


@query(ORDERS_SQL)
def roundtrip_json(spark, folder):
    path = scratch_path(spark, "orders-json") + ".json"
    rows = _orders(spark, folder)
    sinks.write_json(rows, path)
    back = readers.read_dataset(spark, path, lines=True)
    return readers.with_dates(back, "o_orderdate").select(
        *[F.to_date(c).alias(c) if c == "o_orderdate" else F.col(c) for c in rows.columns]
    )


TRICKY_SQL = """'{"a}[' || o_orderpriority || '\\"]' || chr(10) || 'é'"""


@query(f"SELECT o_orderkey, o_totalprice, {TRICKY_SQL} AS note, [o_custkey, o_orderkey] AS keys FROM orders")
def roundtrip_json_array(spark, folder):
    """Files that each hold one array of records, with braces, quotes and escapes in their texts, read in parallel parts."""
    path = scratch_path(spark, "orders-array") + ".json"
    note = F.concat(F.lit('{"a}['), "o_orderpriority", F.lit('\\"]\né'))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", note.alias("note"), F.array("o_custkey", "o_orderkey").alias("keys"))
    dealt = orders.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(64)).alias("part"), "o_orderkey", F.to_json(F.struct(*orders.columns)).alias("record"))
    order = W.partitionBy("part").orderBy("o_orderkey")
    first, last = F.row_number().over(order) == 1, F.lead("o_orderkey").over(order).isNull()
    line = F.concat(F.when(first, "[").otherwise(""), "record", F.when(last, "]").otherwise(","))
    dealt.select("part", line.alias("line")).write.partitionBy("part").text(path)
    return readers.read_dataset(spark, path).select(*orders.columns)


@query("SELECT c_custkey, c_name || ' Müller' || CASE WHEN c_custkey % 7 = 0 THEN chr(65533) ELSE '' END AS name FROM customer")
def roundtrip_utf8(spark, folder):
    """A UTF-8 file in which the replacement character itself occurs."""
    path = scratch_path(spark, "names") + ".csv"
    mark = F.when(F.col("c_custkey") % 7 == 0, F.lit("\ufffd")).otherwise("")
    rows = table(spark, folder, "customer").select("c_custkey", F.concat("c_name", F.lit(" Müller"), mark).alias("name"))
    sinks.write_csv(rows, path)
    return readers.read_dataset(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "name")


@query("SELECT c_custkey, c_name || ' ' || chr(8364) || 'ü' AS \"größe\" FROM customer")
def roundtrip_cp1252(spark, folder):
    """A Windows-1252 file: bytes that are controls in Latin-1."""
    path = scratch_path(spark, "names-1252") + ".csv"
    rows = table(spark, folder, "customer").select("c_custkey", F.concat("c_name", F.lit(" \x80ü")).alias("größe"))
    rows.write.options(header=True, encoding="ISO-8859-1").csv(path)  # the byte 80 is the euro sign in Windows-1252
    return readers.read_dataset(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "größe")


@query(ORDERS_SQL)
def roundtrip_parquet(spark, folder):
    path = scratch_path(spark, "orders")
    sinks.write_sections({"orders": _orders(spark, folder)}, path)
    return readers.read_dataset(spark, f"{path}/orders", "parquet")


@query("SELECT c_mktsegment || ' ' || chr(252) AS department, count(*) AS members FROM customer GROUP BY 1")
def department_file(spark, folder):
    """A departmental Latin-1 file, read as such."""
    path = scratch_path(spark, "department") + ".csv"
    rows = table(spark, folder, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" ü")).alias("department"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_department(spark, path).groupBy("department").agg(F.count(F.lit(1)).alias("members"))


@query(
    """SELECT label, count(*) AS examples FROM (SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS label FROM orders
      UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders WHERE trim(o_orderpriority) <> ''
      UNION SELECT DISTINCT 'l_returnflag', l_returnflag FROM lineitem) GROUP BY 1"""
)
def training_union(spark, folder):
    """Labelled descriptions from several tables, trimmed and without repeats."""

    def described(name, column):
        value = F.col(column)
        return table(spark, folder, name).select(
            F.lit(f" {column}").alias("column_name"), F.concat(value, F.lit(" ")).alias("sample_values"), F.lit(None).cast("string").alias("dtype"), value.alias("label")
        )

    parts = [described("orders", "o_orderstatus"), described("orders", "o_orderpriority"), described("lineitem", "l_returnflag")]
    return readers.union_training(parts).groupBy("label").agg(F.count(F.lit(1)).alias("examples"))


@query(
    """SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS parsed,
    CAST(sum(o_custkey) FILTER (o_orderkey % 3 <> 0) AS BIGINT) AS customers FROM orders GROUP BY 1"""
)
def loose_json_rows(spark, folder):
    """Texts that are nearly JSON, and every third one none at all."""
    made = F.concat(F.lit("{customer: "), F.col("o_custkey").cast("string"), F.lit(", 'ratio': NaN} // from orders"))
    texts = table(spark, folder, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit("customer 1")).otherwise(made).alias("t"))
    parsed = sinks.loose_json(texts, "t", "customer BIGINT, ratio DOUBLE")
    return parsed.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count("parsed.customer").alias("parsed"), F.sum("parsed.customer").alias("customers")
    )


@query(
    """SELECT s_suppkey, s_name || ' ' || chr(233) AS label, s_acctbal AS "Amount" FROM supplier"""
)
def roundtrip_latin1(spark, folder):
    """A Latin-1 file is recognised by its unreadable UTF-8 and read again."""
    path = scratch_path(spark, "supplier") + ".csv"
    rows = table(spark, folder, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" é")).alias("label"), F.col("s_acctbal").alias("Sales"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.with_amount(readers.read_dataset(spark, path)).drop("Sales")


@query(
    with_orders(
        """SELECT * FROM (SELECT 'kpis' AS section, 'total_orders' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders_fact
        UNION ALL SELECT 'kpis', 'unique_customers', CAST(count(DISTINCT customer_id) AS VARCHAR) FROM orders_fact
        UNION ALL SELECT 'regions', 'name', region FROM orders_fact GROUP BY region
        UNION ALL SELECT 'regions', 'orders', CAST(count(*) AS VARCHAR) FROM orders_fact GROUP BY region)"""
    )
)
def export_long_form(spark, folder):
    rows = orders_fact(spark, folder, ["customer_id", "date", "total_amount", "region"])
    sections = {
        "kpis": kpi.business_kpis(rows).select("total_orders", "unique_customers"),
        "regions": rows.groupBy(F.col("region").alias("name")).agg(F.count(F.lit(1)).alias("orders")),
    }
    path = scratch_path(spark, "export")
    sinks.write_sections(sections, path)
    return sinks.long_form({name: spark.read.parquet(f"{path}/{name}") for name in sections})


@query(
    with_sales(
        """SELECT * FROM (SELECT 'kpis' AS section, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'metadata', 1
        UNION ALL SELECT 'trends', least(12, count(DISTINCT strftime(date, '%Y-%m'))) FROM sales
        UNION ALL SELECT 'categories', least(10, count(DISTINCT product_category)) FROM sales
        UNION ALL SELECT 'segments', 4 UNION ALL SELECT 'forecast', 30
        UNION ALL SELECT 'at_risk', least(20, count(*)) FROM churn WHERE score >= 40)""",
        BASE_SQL.format(fact="sales"),
        CHURN_SQL,
    )
)
def export_report(spark, folder):
    """Write the seven report parts as CSV folders and count what can be read back."""
    rows = write_once(sales(spark, folder, ["date", "customer_id", "product_category", "total_amount"]))  # joined once for all parts
    sections = report_sections(rows, profile.quality_score(rows))
    path = scratch_path(spark, "report")
    sinks.write_sections(sections, path, "csv")
    counts = [
        readers.read_dataset(spark, f"{path}/{name}", "csv").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n")
        for name in sections
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    """SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS amount, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ts,
    CAST(o_orderkey AS BIGINT) AS k FROM orders"""
)
def json_safe_rows(spark, folder):
    infinite = F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    rows = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, infinite).otherwise(F.col("o_totalprice")).alias("amount"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("k"),
    )
    return sinks.json_safe(rows)


@query(
    """SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS "user", CAST(o_orderdate AS DATE) AS analyzed_at, o_orderkey AS run_id, o_totalprice AS total_revenue,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders) WHERE position <= 5"""
)
def run_history_last5(spark, folder):
    history = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("user"), F.to_date("o_orderdate").alias("analyzed_at"),
        F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("total_revenue"),
    )
    runs = sinks.run_history(spark, scratch_path(spark, "runs"), history.schema, ties=("run_id",))
    runs.append(history.where(F.col("total_revenue") < 250000))
    runs.compact()
    runs.append(history.where(F.col("total_revenue") >= 250000))
    return sinks.recent_runs(runs.read(), ties=("run_id",))


@query("SELECT o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS created_at FROM orders")
def report_history(spark, folder):
    path = scratch_path(spark, "reports")
    table(spark, folder, "orders").select(F.col("o_orderkey").alias("report_id"), F.to_date("o_orderdate").alias("created_at")).write.parquet(path)
    return sinks.report_history(spark, path)


@query(
    with_orders(
        """SELECT 'region' AS key, region AS value FROM (SELECT DISTINCT region FROM orders_fact)
        UNION ALL SELECT 'summary.orders', CAST(count(*) AS VARCHAR) FROM orders_fact GROUP BY region
        UNION ALL SELECT 'summary.customers', CAST(count(DISTINCT customer_id) AS VARCHAR) FROM orders_fact GROUP BY region
        UNION ALL SELECT 'rows[' || i || '].country', country FROM (SELECT region, country, row_number() OVER (PARTITION BY region ORDER BY country) - 1 AS i FROM orders_fact GROUP BY region, country)
        UNION ALL SELECT 'rows[' || i || '].orders', CAST(n AS VARCHAR) FROM (SELECT region, count(*) AS n, row_number() OVER (PARTITION BY region ORDER BY country) - 1 AS i FROM orders_fact GROUP BY region, country)"""
    )
)
def result_flatten(spark, folder):
    """A nested result per region (summary struct, list of countries) to key/value rows."""
    rows = orders_fact(spark, folder, ["region", "country", "customer_id"])
    per = rows.groupBy("region", "country").agg(F.count(F.lit(1)).alias("orders"))
    lists = per.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("country", "orders"))).alias("rows"))
    summary = rows.groupBy("region").agg(
        F.struct(F.count(F.lit(1)).alias("orders"), F.count_distinct("customer_id").alias("customers")).alias("summary")
    )
    return sinks.flatten(summary.join(lists, "region").select("region", "summary", "rows"))


@query("SELECT least(count(*), 50) AS n FROM orders")
def preview_size(spark, folder):
    """A preview never shows more than 50 rows."""
    return readers.preview(table(spark, folder, "orders"), 500).agg(F.count(F.lit(1)).alias("n"))


DICTIONARY = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, '' AS description, count(*) - count({c}) AS missing_count FROM orders"""
        for c, t in DICTIONARY.items()
    )
)
def data_dictionary(spark, folder):
    """The dictionary next to the missing values of every column."""
    orders = table(spark, folder, "orders")
    missing = profile.missing_values(orders).select("column", "missing_count")
    return sinks.data_dictionary(orders).join(missing, "column")
