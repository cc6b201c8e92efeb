"""Queries over tables as spreadsheets: inference, relations, aggregates, joins, keyword questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tabular as T
from ..session import table
from .registry import query

STARS = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"]}
ORDERS_CUSTOMER = T.Edge("orders", "o_custkey", "customer", "c_custkey")


def stars(spark, sf_dir, names=tuple(STARS)):
    return {n: table(spark, sf_dir, n) for n in names}


@query("""SELECT column_no, "column", dtype FROM (VALUES (0, 'o_orderkey', 'int'), (1, 'o_custkey', 'int'), (2, 'o_orderstatus', 'text'), (3, 'o_totalprice', 'float'), (4, 'o_orderdate', 'text'), (5, 'o_orderpriority', 'text')) t(column_no, "column", dtype) WHERE (SELECT count(*) FROM orders WHERE try_cast(o_totalprice::VARCHAR AS DOUBLE) IS NULL) = 0""")
def infer_schema(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return T.infer_types(orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns]))


@query("SELECT c_custkey, try_cast(c_acctbal::VARCHAR AS DOUBLE) AS c_acctbal, try_cast(c_name AS BIGINT) AS c_name FROM customer")
def coerce_values(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return T.typed(rows.select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_name"), {"c_custkey": "int", "c_acctbal": "float", "c_name": "int"})


def pools(spark, sf_dir):
    tables = {n: d.select(*[c for c, t in d.dtypes if t in ("bigint", "int", "string")]) for n, d in stars(spark, sf_dir).items()}
    dtypes = {n: {c: k for c, _, k in T.info(n, d).columns} for n, d in tables.items()}
    return T.value_pools(tables, STARS, dtypes)


COLUMNS = {"customer": "c_custkey c_name c_nationkey c_mktsegment", "nation": "n_nationkey n_name n_regionkey", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "part": "p_partkey p_name p_brand p_type p_size", "region": "r_regionkey r_name", "supplier": "s_suppkey s_name s_nationkey"}
INTS = {"c_custkey", "c_nationkey", "n_nationkey", "n_regionkey", "o_orderkey", "o_custkey", "p_partkey", "p_size", "r_regionkey", "s_suppkey", "s_nationkey"}
POOLS = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS tbl, '{c}' AS col, '{'int' if c in INTS else 'text'}' AS dtype, regexp_replace(lower(trim({c}::VARCHAR)), '\\s+', ' ', 'g') AS value FROM (SELECT {c} FROM {t} ORDER BY {STARS[t][0]} LIMIT 2000) WHERE {c} IS NOT NULL"
    for t, cs in COLUMNS.items()
    for c in cs.split()
)


@query(f"SELECT tbl, col, dtype, count(*) AS n, min(value) AS least FROM ({POOLS}) WHERE value <> '' GROUP BY ALL")
def value_pools(spark, sf_dir):
    return pools(spark, sf_dir).groupBy("tbl", "col", "dtype").agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query(f"""WITH p AS (SELECT * FROM ({POOLS}) WHERE value <> ''), s AS (SELECT tbl, col, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT a.tbl AS from_table, a.col AS from_col, b.tbl AS to_table, b.col AS to_col, a.dtype = b.dtype AS same, count(*) AS shared_values FROM p a JOIN p b ON a.value = b.value AND a.tbl < b.tbl GROUP BY ALL)
SELECT from_table, from_col, to_table, to_col, CASE WHEN from_col = to_col THEN 'shared-column' ELSE 'value-overlap' END AS kind, shared_values FROM m JOIN s s1 ON s1.tbl = from_table AND s1.col = from_col JOIN s s2 ON s2.tbl = to_table AND s2.col = to_col
WHERE (from_col = to_col AND shared_values >= 2) OR (from_col <> to_col AND same AND shared_values >= 5 AND shared_values * 2 >= least(s1.n, s2.n))""")
def detect_relations(spark, sf_dir):
    return T.relations(pools(spark, sf_dir), most=None)


@query("SELECT 'nation' AS tbl, count(*) AS n_rows, 'Sheet nation: ' || count(*) || ' rows. Columns: n_nationkey (int), n_name (string), n_regionkey (int)' AS summary FROM nation")
def sheet_summary(spark, sf_dir):
    return T.sheet_summary("nation", table(spark, sf_dir, "nation"))


JOINED = "customer JOIN orders ON o_custkey = c_custkey"
#: question, the SQL of its rows (group_value, value)
JOINED_QUESTIONS = (
    ("total o_totalprice of orders for customers", f"SELECT NULL, round(sum(o_totalprice), 2) FROM {JOINED}"),
    ("count o_orderkey of orders for customer", f"SELECT NULL, count(o_orderkey) FROM {JOINED}"),
    ("count c_mktsegment and o_orderstatus group", f"SELECT c_mktsegment, count(*) FROM {JOINED} GROUP BY 1"),
    ("max c_acctbal of customer by o_orderpriority of orders", f"SELECT o_orderpriority, max(c_acctbal) FROM {JOINED} GROUP BY 1"),
)


@query(" UNION ALL ".join(f"SELECT {i} AS question_no, g::VARCHAR AS group_value, v::DOUBLE AS value FROM ({sql}) AS t(g, v)" for i, (_, sql) in enumerate(JOINED_QUESTIONS)))
def keyword_joined(spark, sf_dir):
    """Counts and other aggregates over two tables, with and without groups."""
    tables = stars(spark, sf_dir, ("customer", "orders"))
    infos, rows = [T.info(n, d) for n, d in tables.items()], None
    for i, (question, _) in enumerate(JOINED_QUESTIONS):
        got = T.run(T.ask_joined(question, infos, [ORDERS_CUSTOMER]), tables, [ORDERS_CUSTOMER])
        group = F.col("group_value").cast("string") if "group_value" in got.columns else F.lit(None).cast("string")
        part = got.select(F.lit(i).alias("question_no"), group.alias("group_value"), F.round(F.col("value").cast("double"), 2).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(f"SELECT c_name AS customer_c_name, o_orderdate AS orders_o_orderdate FROM {JOINED} ORDER BY 1, 2 LIMIT 200")
def keyword_columns(spark, sf_dir):
    tables = stars(spark, sf_dir, ("customer", "orders"))
    plan = T.ask_joined("list c_name of customer and o_orderdate of orders", [T.info(n, d) for n, d in tables.items()], [ORDERS_CUSTOMER])
    return T.select(plan, tables, [ORDERS_CUSTOMER])


@query("""WITH a AS (SELECT o_orderpriority AS g, count(o_custkey) AS n FROM orders GROUP BY 1) SELECT 'a' AS source_id, 'orders' AS "table", count(*) AS n_rows,
 'Excel result — a.xlsx / sheet orders (SQL: SELECT orders.o_orderpriority, COUNT(orders.o_custkey) FROM orders GROUP BY orders.o_orderpriority LIMIT 200)' || chr(10) || 'group_value | value' || chr(10) || string_agg(g || ' | ' || n, chr(10) ORDER BY g) AS content FROM a
 UNION ALL SELECT 'b', NULL, NULL, 'AnalysisException' UNION ALL SELECT 'c', 'nation', 1, 'Excel result — c.xlsx / sheet nation (SQL: SELECT COUNT(*) FROM nation)' || chr(10) || 'value' || chr(10) || count(*) FROM nation""")
def excel_answers(spark, sf_dir):
    """One question of three workbooks, of which the second can't be read."""
    sources = [
        T.Workbook("a", "a.xlsx", lambda: stars(spark, sf_dir, ("orders",))),
        T.Workbook("b", "b.xlsx", lambda: {"gone": table(spark, sf_dir, "no_such_table")}),
        T.Workbook("c", "c.xlsx", lambda: stars(spark, sf_dir, ("nation",))),
    ]
    found, passed = T.answers("count o_custkey by o_orderpriority", sources)
    rows = [(a.source_id, a.table, len(a.rows), a.content) for a in found] + [(s, None, None, why) for s, why in passed]
    return spark.createDataFrame(rows, "source_id string, table string, n_rows long, content string")


def asked(spark, sf_dir, question, *names):
    tables = stars(spark, sf_dir, names)
    infos = [T.info(n, d) for n, d in tables.items()]
    plan = T.ask_joined(question, infos, [ORDERS_CUSTOMER]) or T.ask(question, infos)
    return T.run(plan, tables, [ORDERS_CUSTOMER])


@query("SELECT round(sum(o_totalprice), 2) AS value FROM orders")
def tabular_sum(spark, sf_dir):
    return asked(spark, sf_dir, "what is the sum of o_totalprice in orders", "orders").select(F.round("value", 2).alias("value"))


@query("SELECT o_orderpriority AS group_value, count(o_custkey) AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 200")
def tabular_count_by(spark, sf_dir):
    return asked(spark, sf_dir, "count o_custkey in orders by o_orderpriority", "orders")


@query("SELECT l_returnflag AS group_value, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1")
def tabular_avg(spark, sf_dir):
    found = T.run(T.Aggregate("avg", "lineitem", "l_quantity", ("lineitem", "l_returnflag")), {"lineitem": table(spark, sf_dir, "lineitem")})
    return found.select("group_value", F.round("value", 6).alias("value"))


@query("SELECT o_orderstatus AS group_value, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def tabular_minmax(spark, sf_dir):
    tables = {"orders": table(spark, sf_dir, "orders")}
    by = ("orders", "o_orderstatus")
    least = T.run(T.Aggregate("min", "orders", "o_totalprice", by), tables).withColumnRenamed("value", "least")
    return least.join(T.run(T.Aggregate("max", "orders", "o_totalprice", by), tables).withColumnRenamed("value", "most"), "group_value")


@query("SELECT c_mktsegment AS group_value, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 1 LIMIT 200")
def tabular_join_agg(spark, sf_dir):
    found = asked(spark, sf_dir, "total o_totalprice of orders by c_mktsegment of customer", "orders", "customer")
    return found.select("group_value", F.round("value", 2).alias("value"))
