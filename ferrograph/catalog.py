"""Queries of the core operators on the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.config import EngineConfig, Ingestion, Network, Training
from ferrograph.functions import vector
from ferrograph.operators import clean, entities, graph, insight, keys, names, network, profile, relations
from ferrograph.plans.store import forget_at_exit, new_path
from ferrograph.sources import readers, writers
from ferrograph.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def graph_query(sql: str | None = None) -> Callable[[Callable[[DataFrame, DataFrame], DataFrame]], Query]:
    """A query of (vertices, edges) of the whole graph of the tables."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        _QUERIES[f.__name__] = lambda spark, d: f(vertices(spark, d), edges(spark, d))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- views over the tables, in both dialects -------------------------------------------------------------------------

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUMBERS = LINES[:8]


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Orders with blanks, bad numbers, dates in several formats, nulls and truth values as text."""
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(
        k.alias("idx"),
        F.when(k % 7 == 0, None).when(k % 29 == 0, "nan").otherwise(F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))).alias("status"),
        F.when(k % 11 == 0, "n/a").when(k % 13 == 0, None).otherwise(F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).alias("cents"),
        F.when(k % 5 == 0, "soon").when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 4 == 0, "Yes").when(k % 4 == 1, " 0 ").when(k % 4 == 2, "TRUE").otherwise("maybe").alias("flag"),
        F.when(k % 6 == 0, None).otherwise(F.col("o_orderpriority")).alias("note"),
        F.when(k % 3 == 1, None).otherwise(F.col("o_orderdate")).alias("ts"),
    )


DIRTY = """d AS (SELECT o_orderkey AS idx,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'nan' ELSE '  ' || o_orderstatus || ' ' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS cents,
  CASE WHEN o_orderkey % 5 = 0 THEN 'soon' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' 0 ' WHEN 2 THEN 'TRUE' ELSE 'maybe' END AS flag,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS note,
  CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderdate END AS ts FROM orders)"""


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Orders with keys as text, and columns that hold part of other columns' values."""
    pad = lambda p, c: F.concat(F.lit(p), F.lpad(c.cast("string"), 8, "0"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, d, "orders").select(
        o.alias("idx"),
        pad("ORD-", o).alias("order_id"),
        pad("CUST-", c).alias("customer_id"),
        F.when(c % 2 == 0, pad("CUST-", c)).alias("payer_customer_id"),
        F.when(c % 3 == 0, pad("CUST-", c)).otherwise(pad("X-", c)).alias("other_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"),
        F.concat_ws("-", F.lpad(F.hex(o), 8, "0"), F.lit("0000-4000-8000"), F.lpad(F.hex(c), 12, "0")).alias("trace"),
    )


KEYED = """k AS (SELECT o_orderkey AS idx, 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS order_id,
  'CUST-' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS customer_id,
  CASE WHEN o_custkey % 2 = 0 THEN 'CUST-' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS payer_customer_id,
  CASE WHEN o_custkey % 3 = 0 THEN 'CUST-' ELSE 'X-' END || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS other_id,
  o_orderstatus AS order_status, o_orderpriority AS order_priority FROM orders)"""
KEY_COLUMNS = ["order_id", "customer_id", "payer_customer_id", "other_id", "order_status"]

#: Column names of the wide sales table, by entity.
WIDE = (
    ("Customer", "customer_id"), ("Customer", "customer_name"), ("Customer", "customer_segment"), ("Order", "order_id"), ("Order", "order_date"),
    ("Order", "order_customer_id"), ("Order", "order_total_amount"), ("Order", "order_status"), ("Product", "product_id"), ("Product", "product_item_name"),
    ("Product", "product_brand"), ("Invoice", "invoice_no"), ("Invoice", "invoice_order_id"), ("Supplier", "supplier_key"), ("Supplier", "supplier_phone"),
)


#: Tables whose columns are named as well, by their own names.
NAMED = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "documents", "pages", "conversations")


def wide(spark: SparkSession, d: str) -> DataFrame:
    """(entity, column, place): the columns of the wide table, and of the tables at hand (the table's name is part of each)."""
    named = [*WIDE, *((x.capitalize(), f"{x}_{c}") for x in NAMED for c in t(spark, d, x).columns)]
    return spark.createDataFrame([(e, c, i) for i, (e, c) in enumerate(named)], "entity string, column string, place int")


WIDE_SQL = (
    "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{c}', {i})" for i, (e, c) in enumerate(WIDE)) + ') AS v(entity, "column", place)'
    + "".join(f"\n  UNION ALL SELECT '{x.capitalize()}', '{x}_' || column_name, {100 * (i + 1)} + row_number() OVER () FROM (DESCRIBE {x})" for i, x in enumerate(NAMED)) + ")"
)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer to order status and priority, nation to region, customer to nation: a directed graph with weights."""
    c, o, n = t(spark, d, "customer"), t(spark, d, "orders"), t(spark, d, "nation")
    own = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit(1.0).alias("weight"))
    to_region = n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(0.5))
    use = o.groupBy("o_custkey", "o_orderpriority").count()
    use = use.select(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)), F.col("count").cast("double"))
    more = n.select(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("p"), (F.col("n_regionkey") + 1)), F.lit(0.25)).distinct()
    return own.union(to_region).union(use).union(more)


EDGES = """e AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.5 FROM nation
  UNION ALL SELECT 'c' || o_custkey, 'p' || substr(o_orderpriority, 1, 1), count(*)::DOUBLE FROM orders GROUP BY o_custkey, o_orderpriority
  UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'p' || (n_regionkey + 1), 0.25 FROM nation),
v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e UNION ALL SELECT 's' || s_suppkey FROM supplier))"""


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """The ends of the edges, and the suppliers, that have none."""
    e = edges(spark, d)
    alone = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return e.select(F.col("src").alias("id")).union(e.select("dst")).union(alone).distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


# --- profile ----------------------------------------------------------------------------------------------------------


def each(columns: list[str], sql: str) -> str:
    """The same SELECT for every column, with {c} for its name."""
    return "\nUNION ALL ".join(sql.replace("{c}", c) for c in columns)


@query(each(ORDERS, "SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS missing_rate FROM orders"))
def profile_missing_orders(spark, d):
    return rounded(profile.missing_rate(t(spark, d, "orders")), "missing_rate")


@query("WITH " + DIRTY + each(["status", "cents", "day", "flag", "note", "ts"], " SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS missing_rate FROM d"))
def missing_rate(spark, d):
    return rounded(profile.missing_rate(dirty(spark, d), ["status", "cents", "day", "flag", "note", "ts"]), "missing_rate")


@query(each(LINES, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS unique_ratio FROM lineitem"))
def distinct_ratio(spark, d):
    return rounded(profile.distinct_ratio(t(spark, d, "lineitem")), "unique_ratio")


@query("SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id % 10 AS u, round(value) AS v FROM events)) AS n_duplicates FROM events")
def duplicate_rows(spark, d):
    return profile.duplicate_rows(t(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("u"), F.round("value").alias("v")))


_SHORT = "s AS (SELECT o_orderkey, o_orderstatus, 1 AS one, CAST(NULL AS VARCHAR) AS nothing, o_custkey FROM orders)"


def _short(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("one"), F.lit(None).cast("string").alias("nothing"), "o_custkey")


@query(f"WITH {_SHORT} SELECT * FROM (" + each(["o_orderkey", "o_orderstatus", "one", "nothing", "o_custkey"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM s") + ") WHERE n_distinct <= 1")
def constant_columns(spark, d):
    return profile.constant_columns(_short(spark, d))


@query(f"WITH {_SHORT} SELECT * FROM (" + each(["o_orderkey", "o_orderstatus", "one", "nothing", "o_custkey"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS unique_ratio FROM s") + ") WHERE unique_ratio > 0.95")
def high_cardinality(spark, d):
    return rounded(profile.high_cardinality(_short(spark, d)), "unique_ratio")


@query("WITH s AS (" + each(LINE_NUMBERS, "SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem") + """)
SELECT "column", round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max,
  round(CASE WHEN max > min THEN mean / (max - min + 1e-9) ELSE 0 END, 4) AS norm_mean, round(std / (abs(mean) + 1e-9), 4) AS cv FROM s""")
def numeric_stats(spark, d):
    return rounded(profile.numeric_stats(t(spark, d, "lineitem")), "mean", "std", "min", "max", "norm_mean", "cv", places=4)


@query(each(["text", "lang", "source"], "SELECT '{c}' AS \"column\", round(avg(len(regexp_extract_all({c}, '[^ \\t\\n\\x0B\\f\\r]+'))), 4) AS avg_tokens FROM documents"))
def avg_tokens(spark, d):
    return rounded(profile.avg_tokens(t(spark, d, "documents"), ["text", "lang", "source"]), "avg_tokens", places=4)


CATS = ["o_orderstatus", "o_orderpriority", "o_custkey"]
_COUNTS = "n AS (" + each(CATS, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}") + ")"


@query(f"WITH {_COUNTS}" + ' SELECT "column", value, n FROM n')
def value_counts(spark, d):
    return profile.value_counts(t(spark, d, "orders"), CATS)


@query(f"WITH {_COUNTS}" + """, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS p, sum(n) OVER (PARTITION BY "column") AS a FROM n),
g AS (SELECT DISTINCT "column", a, unnest([1, 2, 3]) AS place FROM r)
SELECT g."column", g.place, round(coalesce(r.n, 0) / g.a, 6) AS freq FROM g LEFT JOIN r ON r."column" = g."column" AND r.p = g.place""")
def topk_freq(spark, d):
    return rounded(profile.topk_freq(profile.value_counts(t(spark, d, "orders"), CATS)), "freq")


@query(f"WITH {_COUNTS}" + ' SELECT "column", round(-sum(n / a * ln(n / a)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS a FROM n) GROUP BY "column"')
def entropy_categorical(spark, d):
    return rounded(profile.entropy(profile.value_counts(t(spark, d, "orders"), CATS)), "entropy")


@query(f"WITH {_COUNTS}" + ', m AS (SELECT "column", max(n) AS n FROM n GROUP BY "column") SELECT "column", min(value) AS mode, any_value(n) AS n FROM n JOIN m USING ("column", n) GROUP BY "column"')
def mode_value(spark, d):
    return profile.mode_value(profile.value_counts(t(spark, d, "orders"), CATS))


HIST = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query("WITH h AS (" + each(HIST, """SELECT '{c}' AS "column", CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * b), b - 1) ELSE 0 END AS p, count(*) AS n
  FROM (SELECT {c}::DOUBLE AS v, (SELECT min({c})::DOUBLE FROM lineitem) AS lo, (SELECT max({c})::DOUBLE FROM lineitem) AS hi,
    (SELECT least(count(DISTINCT {c}), 20) FROM lineitem) AS b FROM lineitem WHERE {c} IS NOT NULL) GROUP BY p""") + """)
SELECT "column", round(-sum(n / a * ln(n / a)), 5) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS a FROM h) GROUP BY "column" """)
def entropy_numeric_hist(spark, d):
    return rounded(profile.entropy_numeric(t(spark, d, "lineitem"), HIST), "entropy", places=5)


@query("""SELECT 'o_orderkey' AS "column", 'numeric' AS semantic_type UNION ALL SELECT 'o_custkey', 'numeric' UNION ALL SELECT 'o_totalprice', 'numeric'
UNION ALL SELECT 'o_orderdate', 'datetime'
UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) / count(*) > 0.95 THEN 'id' WHEN avg(len(regexp_extract_all(o_orderstatus, '[^ ]+'))) > 3 THEN 'text' ELSE 'categorical' END FROM orders
UNION ALL SELECT 'o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) / count(*) > 0.95 THEN 'id' WHEN avg(len(regexp_extract_all(o_orderpriority, '[^ ]+'))) > 3 THEN 'text' ELSE 'categorical' END FROM orders""")
def semantic_types(spark, d):
    return profile.semantic_types(t(spark, d, "orders"), ["o_orderkey"])


@query("""WITH p AS (SELECT doc_id, text, lang, CAST(doc_id AS VARCHAR) || '-x' AS code, CASE doc_id % 2 WHEN 0 THEN 'yes' ELSE 'No' END AS flag,
  strftime(DATE '2022-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y%m%d') AS day, CAST(NULL AS VARCHAR) AS nothing FROM documents)
SELECT 'text' AS "column", CASE WHEN count(DISTINCT text) / count(*) > 0.95 THEN 'id' ELSE 'text' END AS semantic_type FROM p
UNION ALL SELECT 'lang', 'categorical' UNION ALL SELECT 'code', 'id' UNION ALL SELECT 'flag', 'boolean' UNION ALL SELECT 'day', 'datetime' UNION ALL SELECT 'nothing', 'boolean' """)
def semantic_types_text(spark, d):
    k = F.col("doc_id")
    p = t(spark, d, "documents").select(
        "doc_id", "text", "lang", F.concat(k.cast("string"), F.lit("-x")).alias("code"), F.when(k % 2 == 0, "yes").otherwise("No").alias("flag"),
        F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (k % 700).cast("int")), "yyyyMMdd").alias("day"), F.lit(None).cast("string").alias("nothing"),
    )
    return profile.semantic_types(p, ["doc_id"], ["text", "lang", "code", "flag", "day", "nothing"])


_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_PROFILE = """SELECT '{c}' AS "column", n_rows, n_missing, round(n_missing / n_rows, 6) AS missing_rate, n_distinct, round(n_distinct / n_rows, 6) AS unique_ratio, {numbers}, {words} AS avg_tokens,
  round({entropy}, 5) AS entropy, round(coalesce(f[1], 0) / (n_rows - n_missing), 6) AS top1, round(coalesce(f[2], 0) / (n_rows - n_missing), 6) AS top2, round(coalesce(f[3], 0) / (n_rows - n_missing), 6) AS top3,
  {kind} AS semantic_type FROM (SELECT count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS lo, max({x}) AS hi FROM orders),
  (SELECT list(n ORDER BY n DESC) AS f, sum(n) AS a, sum(n * ln(n)) AS nln FROM (SELECT count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}))"""
_STATS = "round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(CASE WHEN hi > lo THEN mean / (hi - lo + 1e-9) ELSE 0 END, 4) AS norm_mean, round(std / (abs(mean) + 1e-9), 4) AS cv"
_BINS = """(SELECT -sum(n / a * ln(n / a)) FROM (SELECT *, sum(n) OVER () AS a FROM (SELECT least(floor((o.{c}::DOUBLE - lo) / (hi - lo) * least(n_distinct, 20)), least(n_distinct, 20) - 1) AS p, count(*) AS n FROM orders o GROUP BY p)))"""
_KIND = "(SELECT CASE WHEN count(DISTINCT {c}) / count(*) > 0.95 THEN 'id' WHEN avg(len(regexp_extract_all({c}, '[^ ]+'))) > 3 THEN 'text' ELSE 'categorical' END FROM orders)"


def _profile_sql(c: str) -> str:
    number, words = c in _NUMBERS, c in ("o_orderstatus", "o_orderpriority")
    return _PROFILE.format(
        c=c,
        x=f"{c}::DOUBLE" if number else "NULL::DOUBLE",
        numbers=_STATS if number else ", ".join(f"0.0::DOUBLE AS {k}" for k in ("mean", "std", "min", "max", "norm_mean", "cv")),
        words=f"(SELECT round(avg(len(regexp_extract_all({c}, '[^ ]+'))), 4) FROM orders)" if words else "0.0::DOUBLE",
        entropy=_BINS.format(c=c) if number else "greatest(ln(a) - nln / a, 0)",
        kind="'numeric'" if number else _KIND.format(c=c) if words else "'datetime'",
    )


@query("\nUNION ALL ".join(map(_profile_sql, ORDERS)))
def column_profile(spark, d):
    out = profile.column_profile(t(spark, d, "orders").select(*ORDERS), ["o_orderkey"])
    out = rounded(out, "missing_rate", "unique_ratio", "top1", "top2", "top3")
    return rounded(rounded(out, "mean", "std", "min", "max", "norm_mean", "cv", "avg_tokens", places=4), "entropy", places=5)


# --- cleaning ---------------------------------------------------------------------------------------------------------


@query(f"WITH {DIRTY} SELECT idx, CASE WHEN lower(trim(status)) = 'nan' THEN NULL ELSE trim(status) END AS status, trim(flag) AS flag FROM d")
def trim_strings(spark, d):
    return clean.trim_strings(dirty(spark, d).select("idx", "status", "flag"))


@query(f"WITH {DIRTY} SELECT idx, try_cast(cents AS DOUBLE) AS cents FROM d")
def to_numeric_coerce(spark, d):
    return clean.coerce(dirty(spark, d).select("idx", "cents"), {"cents": "numeric"})


@query(f"WITH {DIRTY} SELECT idx, strftime(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%Y%m%d')), '%Y-%m-%d') AS day FROM d")
def to_datetime_coerce(spark, d):
    out = clean.coerce(dirty(spark, d).select("idx", "day"), {"day": "datetime"})
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {DIRTY} SELECT idx, CASE WHEN lower(trim(flag)) IN ('1', 'true', 'yes') THEN true WHEN lower(trim(flag)) IN ('0', 'false', 'no') THEN false END AS flag FROM d")
def bool_map(spark, d):
    return clean.coerce(dirty(spark, d).select("idx", "flag"), {"flag": "boolean"})


@query(f"WITH {DIRTY}, n AS (SELECT idx, try_cast(cents AS DOUBLE) AS cents FROM d) SELECT idx, coalesce(cents, (SELECT median(cents) FROM n)) AS cents FROM n")
def fill_median(spark, d):
    return clean.fill_median(clean.coerce(dirty(spark, d).select("idx", "cents"), {"cents": "numeric"}), ["cents"])


@query(f"WITH {DIRTY}, m AS (SELECT note, count(*) AS n FROM d WHERE note IS NOT NULL GROUP BY note) SELECT idx, coalesce(note, (SELECT note FROM m ORDER BY n DESC, note LIMIT 1)) AS note FROM d")
def fill_mode(spark, d):
    return clean.fill_mode(dirty(spark, d).select("idx", "note"), ["note"])


@query(f"WITH {DIRTY} SELECT idx, coalesce(note, '') AS note FROM d")
def fill_text(spark, d):
    return clean.fill_text(dirty(spark, d).select("idx", "note"), ["note"])


@query(f"""WITH {DIRTY} SELECT idx, coalesce(last_value(ts IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING),
  first_value(ts IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ts FROM d""")
def ffill_bfill(spark, d):
    return clean.fill_along(dirty(spark, d).select("idx", "ts"), ["ts"], "idx")


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def drop_columns(spark, d):
    return clean.drop_columns(_short(spark, d))


# --- keys -------------------------------------------------------------------------------------------------------------

_SETS = f"WITH {KEYED}, s AS (" + each(KEY_COLUMNS, "SELECT DISTINCT '{c}' AS col, {c} AS value FROM k WHERE {c} IS NOT NULL") + """),
n AS (SELECT col, count(*) AS n FROM s GROUP BY col),
b AS (SELECT x.col AS col_a, y.col AS col_b, x.n AS n_a, y.n AS n_b, (SELECT count(*) FROM s p JOIN s q ON p.value = q.value WHERE p.col = x.col AND q.col = y.col) AS n_both
  FROM n x JOIN n y ON x.col < y.col) """


@query(_SETS + "SELECT * FROM b")
def value_overlap(spark, d):
    return keys.overlaps(keys.value_sets(keyed(spark, d), KEY_COLUMNS))


@query(_SETS + "SELECT col_a, col_b, round(n_both::DOUBLE / (n_a + n_b - n_both), 6) AS jaccard FROM b")
def jaccard_overlap(spark, d):
    return rounded(keys.jaccard_overlap(keys.value_sets(keyed(spark, d), KEY_COLUMNS)), "jaccard")


@query(_SETS + """SELECT CASE WHEN n_a < n_b THEN col_a ELSE col_b END AS child_col, CASE WHEN n_a < n_b THEN col_b ELSE col_a END AS parent_col,
  round(n_both::DOUBLE / least(n_a, n_b), 6) AS overlap FROM b WHERE n_a <> n_b AND n_both::DOUBLE / least(n_a, n_b) > 0.6""")
def fk_pairs(spark, d):
    return rounded(keys.fk_pairs(keys.value_sets(keyed(spark, d), KEY_COLUMNS)), "overlap")


@query("""WITH p AS (SELECT DISTINCT o_orderpriority AS a, o_custkey AS b FROM orders), x AS (SELECT avg(c) AS v FROM (SELECT count(*) AS c FROM p GROUP BY b)),
y AS (SELECT avg(c) AS v FROM (SELECT count(*) AS c FROM p GROUP BY a))
SELECT round(x.v, 6) AS avg_a_per_b, round(y.v, 6) AS avg_b_per_a, CASE WHEN x.v <= 1.1 AND y.v <= 1.1 THEN '1:1' WHEN y.v > 1.5 THEN 'N:N' ELSE '1:N' END AS cardinality FROM x, y""")
def cardinality(spark, d):
    return rounded(keys.cardinality(t(spark, d, "orders"), "o_orderpriority", "o_custkey"), "avg_a_per_b", "avg_b_per_a")


@query("""WITH f AS (SELECT o_orderkey AS v FROM orders ORDER BY o_orderkey LIMIT 50), g AS (SELECT v - lag(v) OVER (ORDER BY v) AS x FROM f)
SELECT 'o_orderkey' AS "column", round(count(*) FILTER (x = 1) / count(x), 6) AS share FROM g""")
def sequential_id(spark, d):
    return rounded(keys.sequential_share(t(spark, d, "orders"), "o_orderkey", ["o_orderkey"]), "share")


@query("""SELECT 'trace' AS "column", round(avg(CASE WHEN regexp_matches(x, '^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$') THEN 1 ELSE 0 END), 6) AS share
FROM (SELECT lpad(hex(o_orderkey), 8, '0') || '-0000-4000-8000-' || lpad(hex(o_custkey), 12, '0') AS x FROM orders ORDER BY o_orderkey LIMIT 50)""")
def uuid_match(spark, d):
    return rounded(keys.uuid_share(keyed(spark, d), "trace", ["idx"]), "share")


@query(f"WITH {KEYED} " + """SELECT 'order_id' AS "column", true AS is_id UNION ALL SELECT 'customer_id', count(DISTINCT customer_id)::DOUBLE / count(*) > 0.5 FROM k
UNION ALL SELECT 'order_status', false UNION ALL SELECT 'trace', true""")
def id_columns(spark, d):
    return keys.id_columns(keyed(spark, d), ["idx"], ["order_id", "customer_id", "order_status", "trace"])


@query("""SELECT 'order_id' AS "column" UNION ALL SELECT 'trace'""")
def primary_keys(spark, d):
    return keys.primary_keys(keyed(spark, d), ["idx"], ["order_id", "customer_id", "order_status", "trace"])


# --- names ------------------------------------------------------------------------------------------------------------

_TERMS = f"""WITH {WIDE_SQL}, x AS (SELECT "column", list_filter(string_split("column", '_'), lambda s: length(s) >= 2) AS l FROM w),
r AS (SELECT "column", unnest(list_concat(l, CASE WHEN len(l) >= 2 THEN list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) ELSE [] END)) AS term FROM x),
c AS (SELECT "column", term, count(*) AS tf FROM r GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM w),
q AS (SELECT "column", term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN f USING (term), n),
u AS (SELECT "column", term, w / sqrt(sum(w * w) OVER (PARTITION BY "column")) AS weight FROM q) """


@query(f"WITH {WIDE_SQL}" + """ SELECT "column", (i - 1)::INTEGER AS place, string_split("column", '_')[i] AS token FROM (SELECT "column", unnest(range(1, len(string_split("column", '_')) + 1)) AS i FROM w)""")
def name_tokens(spark, d):
    return names.tokens(wide(spark, d))


@query(_TERMS + 'SELECT "column", term, round(weight, 6) AS weight FROM u')
def name_tfidf(spark, d):
    return rounded(names.tfidf(wide(spark, d)), "weight")


@query(_TERMS + 'SELECT a."column" AS col_a, b."column" AS col_b, round(sum(a.weight * b.weight), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a."column" < b."column" GROUP BY ALL')
def name_cosine(spark, d):
    return rounded(names.cosines(names.tfidf(wide(spark, d))), "cosine")


_SIGNALS = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{w}')" for i, (k, ws) in enumerate(names.TYPE_SIGNALS) for w in ws) + ") AS v(p, entity_type, token))"


@query(f"""WITH {WIDE_SQL}, {_SIGNALS}, k AS (SELECT DISTINCT entity, unnest(string_split("column", '_')) AS token FROM w),
s AS (SELECT entity, p, entity_type, count(*) AS score FROM k JOIN g USING (token) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, p) AS n FROM s)
SELECT e.entity, coalesce(b.entity_type, 'business_object') AS entity_type, coalesce(b.score, 0) AS score FROM (SELECT DISTINCT entity FROM w) e LEFT JOIN b ON b.entity = e.entity AND b.n = 1""")
def entity_type_score(spark, d):
    return names.entity_types(wide(spark, d))


# --- relationships ----------------------------------------------------------------------------------------------------

CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("\nUNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(CORR) for b in CORR[i + 1 :]))
def corr_pairs(spark, d):
    return rounded(relations.corr_pairs(t(spark, d, "lineitem"), CORR), "r")


@query("""WITH m AS (SELECT 'Line' AS e, avg(epoch_us(l_shipdate)) AS v FROM lineitem UNION ALL SELECT 'Order', avg(epoch_us(o_orderdate)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.e AS src, b.e AS tgt, floor(abs(b.v - a.v) / 86400000000)::BIGINT AS days FROM m a JOIN m b ON a.e <> b.e""")
def temporal_order(spark, d):
    both = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return relations.temporal_order(both, {"Line": "l_shipdate", "Order": "o_orderdate"})


@query(f"""WITH {WIDE_SQL}, k AS (SELECT entity, "column", place, string_split("column", '_') AS l FROM w), f AS (SELECT *, unnest(range(1, len(l))) AS i FROM k),
h AS (SELECT f.entity AS src, o.entity AS tgt, f."column", f.place FROM f JOIN (SELECT DISTINCT entity FROM w) o ON o.entity <> f.entity
  AND starts_with(f.l[f.i], substr(lower(o.entity), 1, 4)) WHERE f.l[f.i + 1] IN ('id', 'key', 'no', 'num'))
SELECT src, tgt, arg_min("column", place) AS "column" FROM h GROUP BY src, tgt""")
def prefix_refs(spark, d):
    return relations.prefix_refs(wide(spark, d))


_SIG = [("A", "B", 0, 0.5, "fk"), ("A", "B", 1, 0.4, "prefix"), ("A", "B", 3, 0.2, "time"), ("B", "A", 3, 0.2, "time"), ("A", "C", 2, 0.12, "corr"), ("C", "B", 2, 0.25, "corr"), ("C", "B", 3, 0.2, "time")]
_SIG_SQL = "s AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in _SIG) + ") AS v(src, tgt, place, confidence, evidence))"


def _signals(spark):
    return spark.createDataFrame(_SIG, "src string, tgt string, place int, confidence double, evidence string")


@query(f"WITH {_SIG_SQL} SELECT src, tgt, round(least(sum(confidence), 1.0)::DOUBLE, 6) AS confidence, string_agg(evidence, ',' ORDER BY place) AS evidence FROM s GROUP BY src, tgt HAVING least(sum(confidence), 1.0) >= 0.15")
def evidence_fusion(spark, d):
    return rounded(relations.fuse(_signals(spark)).withColumn("evidence", F.array_join("evidence", ",")), "confidence")


@query(f"""WITH {_SIG_SQL}, p AS (SELECT src, tgt, min(place) AS seq FROM s GROUP BY src, tgt),
r AS (SELECT *, row_number() OVER (PARTITION BY least(src, tgt), greatest(src, tgt) ORDER BY seq, src) AS n FROM p) SELECT src, tgt, seq FROM r WHERE n = 1""")
def relationship_dedup(spark, d):
    p = _signals(spark).groupBy("src", "tgt").agg(F.min("place").alias("seq")).withColumn("_o", F.struct("seq", "src"))
    return relations.first_direction(p, "_o").drop("_o")


_KINDS = ["person", "transaction", "document", "product", "reference", "business_object"]
_PAIRS_SQL = "SELECT a.k AS src, b.k AS tgt FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in _KINDS) + "]) AS k) a, (SELECT unnest([" + ", ".join(f"'{k}'" for k in _KINDS) + "]) AS k) b"


@query(f"""WITH p AS ({_PAIRS_SQL}) SELECT src, tgt, CASE """ + " ".join(f"WHEN src = '{s}' AND tgt = '{g}' THEN '{v}'" for s, g, v in relations.VERBS)
       + " " + " ".join(f"WHEN contains(src, '{s}') OR contains(tgt, '{g}') THEN '{v}'" for s, g, v in relations.VERBS) + """ ELSE 'RELATED_TO' END AS verb,
  CASE WHEN tgt IN ('transaction', 'document') THEN 'GENERATES' WHEN src = 'transaction' THEN 'PROCESSES' WHEN src < tgt THEN 'HAS' WHEN src = tgt THEN 'HAS' ELSE 'REFERENCES' END AS label FROM p""")
def verb_lookup(spark, d):
    k = spark.createDataFrame([(a, b) for a in _KINDS for b in _KINDS], "src string, tgt string")
    card = F.when(F.col("src") < F.col("tgt"), "1:1").when(F.col("src") == F.col("tgt"), "1:N").otherwise("N:N")
    return k.select("src", "tgt", relations.verb(F.col("src"), F.col("tgt")).alias("verb"), relations.type_label(F.col("src"), F.col("tgt"), card).alias("label"))


# --- graph ------------------------------------------------------------------------------------------------------------


@query("""SELECT 'entity::' || e AS id, e AS label, e AS entity_name, k AS entity_type, n::BIGINT AS column_count, (SELECT count(*) FROM orders) AS row_count, c AS confidence
FROM (VALUES ('Order', 'transaction', 3, 0.5::DOUBLE), ('Customer', 'person', 2, 1.0::DOUBLE)) AS v(e, k, n, c)""")
def entity_nodes(spark, d):
    e = spark.createDataFrame([("Order", "transaction", ["a", "b", "c"], 0.5), ("Customer", "person", ["x", "y"], 1.0)], "entity_name string, entity_type string, columns array<string>, confidence double")
    return graph.entity_nodes(e, t(spark, d, "orders"))


_INST = f"WITH {KEYED}, i AS (SELECT order_status AS key_value, arg_min(order_id, idx) AS display_label FROM k GROUP BY order_status) "


@query(_INST + "SELECT 'Status::' || key_value AS id, 'Status' AS entity_name, key_value, display_label FROM i")
def instance_nodes(spark, d):
    return graph.instance_nodes(keyed(spark, d), "Status", "order_status", "order_id", "idx")


@query(_INST + "SELECT 'Status::' || key_value AS src, 'entity::Status' AS dst, 'MEMBER_OF' AS edge_type, 1.0::DOUBLE AS weight FROM i")
def member_edges(spark, d):
    return graph.member_edges(instance_nodes(spark, d))


@query(f"""WITH {KEYED}, f AS (SELECT * FROM k ORDER BY idx LIMIT 150), g AS (SELECT * FROM f ORDER BY idx LIMIT 50)
SELECT DISTINCT 'Status::' || order_status AS src, 'Priority::' || order_priority AS dst, 'HAS' AS edge_type, 0.7::DOUBLE AS weight FROM g""")
def fk_edges(spark, d):
    k = keyed(spark, d)
    a, b = (graph.instance_nodes(k, e, c, c, "idx") for e, c in (("Status", "order_status"), ("Priority", "order_priority")))
    return graph.fk_edges(k, a, b, "order_status", "order_priority", "idx", 0.7, "HAS")


@graph_query(f"""WITH {EDGES}, x AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
SELECT v.id, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree, coalesce(sum(o + i), 0)::BIGINT AS degree FROM v LEFT JOIN x ON v.id = x.id GROUP BY v.id""")
def degree(v, e):
    return longs(graph.degrees(v, e), "in_degree", "out_degree", "degree")


@graph_query(f"""WITH {EDGES}, x AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)
SELECT v.id, round(count(x.id)::DOUBLE / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM v LEFT JOIN x ON v.id = x.id GROUP BY v.id""")
def degree_centrality(v, e):
    return rounded(graph.degree_centrality(v, e), "centrality")


@graph_query(f"WITH {EDGES}, n AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m) SELECT n AS n_nodes, m AS n_edges, round(2 * m::DOUBLE / n, 6) AS avg_degree, round(m::DOUBLE / (n * (n - 1)), 6) AS density FROM n")
def density(v, e):
    return rounded(graph.density(v, e), "avg_degree", "density")


@graph_query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
r AS (SELECT id, id AS c FROM v UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.id)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def components(v, e):
    return graph.components(v, e)


@graph_query(f"""WITH {EDGES}, b AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM e WHERE src <> dst),
g AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM b UNION ALL SELECT y FROM b) GROUP BY id),
z AS (SELECT p.x AS i, p.y AS j, q.y AS k FROM b p JOIN b q ON p.y = q.x JOIN b r ON r.x = p.x AND r.y = q.y),
c AS (SELECT id, count(*) AS n FROM (SELECT i AS id FROM z UNION ALL SELECT j FROM z UNION ALL SELECT k FROM z) GROUP BY id)
SELECT v.id, coalesce(c.n, 0) AS triangles, round(CASE WHEN g.n > 1 THEN 2.0 * coalesce(c.n, 0) / (g.n * (g.n - 1)) ELSE 0 END, 6) AS clustering
FROM v LEFT JOIN g USING (id) LEFT JOIN c USING (id)""")
def triangles(v, e):
    return rounded(graph.triangles(v, e), "clustering")


@graph_query(f"""WITH RECURSIVE {EDGES}, l AS (SELECT id, 0 AS level FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.id)
SELECT id, max(level) AS level FROM l GROUP BY id""")
def hierarchy(v, e):
    return graph.hierarchy(v, e)


_RANKS = ["r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS rank FROM v)"] + [
    f"""r{i} AS (SELECT v.id, 0.85 * (coalesce(sum(p.p * q.rank), 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v))
  + 0.15 / (SELECT count(*) FROM v) AS rank FROM v LEFT JOIN p ON p.dst = v.id LEFT JOIN r{i - 1} q ON q.id = p.src GROUP BY v.id)"""
    for i in range(1, 6)
]


@graph_query(f"WITH {EDGES}, p AS (SELECT src, dst, sum(weight) / any_value(t) AS p FROM (SELECT *, sum(weight) OVER (PARTITION BY src) AS t FROM e) GROUP BY src, dst), " + ", ".join(_RANKS) + " SELECT id, round(rank, 8) AS rank FROM r5")
def pagerank_k(v, e):
    return rounded(graph.pagerank(v, e, rounds=5, tolerance=None), "rank", places=8)


@graph_query(f"WITH {EDGES} SELECT id FROM v WHERE id IN (SELECT src FROM e UNION ALL SELECT dst FROM e)")
def isolated_prune(v, e):
    return graph.drop_isolated(v, e)


@graph_query(f"WITH {EDGES} SELECT src, dst, weight FROM e WHERE weight >= 0.4")
def weak_prune(v, e):
    return graph.prune_weak(e, 0.4)


@graph_query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT src AS s, dst AS t, weight AS d, [src, dst] AS path FROM e
  UNION ALL SELECT w.s, e.dst, w.d + e.weight, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.t),
m AS (SELECT s, t, min(d) AS d FROM w GROUP BY s, t), q AS (SELECT path, count(*) OVER (PARTITION BY s, t) AS k FROM w JOIN m USING (s, t, d)),
x AS (SELECT unnest(path[2:-2]) AS id, 1 / k AS part FROM q), n AS (SELECT count(*)::DOUBLE AS n FROM v)
SELECT v.id, round(coalesce(sum(part), 0) / any_value((n - 1) * (n - 2)), 9) AS betweenness FROM v CROSS JOIN n LEFT JOIN x USING (id) GROUP BY v.id""")
def betweenness(v, e):
    return rounded(graph.betweenness(v, e), "betweenness", places=9)


@graph_query()
def louvain(v, e):
    return graph.louvain_communities(v, e)


_LABELS = ", b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), l0 AS (SELECT id, id AS community FROM v)" + "".join(
    f""", l{i} AS (SELECT id, community FROM (SELECT id, community, row_number() OVER (PARTITION BY id ORDER BY sum(weight) DESC, community) AS n
  FROM (SELECT b.src AS id, l.community, b.weight FROM b JOIN l{i - 1} l ON l.id = b.dst UNION ALL SELECT id, community, 0.5 FROM l{i - 1}) GROUP BY id, community) WHERE n = 1)"""
    for i in range(1, 6)
)


@graph_query(f"WITH {EDGES}{_LABELS} SELECT id, community FROM l5")
def label_communities(v, e):
    return graph.label_propagation(v, e, rounds=5)


# --- vectors and scores -----------------------------------------------------------------------------------------------

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""WITH x AS (SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS place FROM x) SELECT query, id, round(cosine, 5) AS cosine, place FROM y WHERE place <= 5""")
def cosine_topk(spark, d):
    v = vectors(spark, d)
    return rounded(longs(insight.cosine_topk(v, v.filter("id % 100 = 0")), "place"), "cosine", places=5)


@query("""WITH x AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings), y AS (SELECT id, i - 1 AS dim, embedding[i]::DOUBLE AS value FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, dim) AS n FROM y) SELECT id, dim, round(value, 6) AS value FROM z WHERE n <= 3""")
def top_dimensions(spark, d):
    out = insight.top_dimensions(vectors(spark, d).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    return rounded(longs(out, "dim"), "value")


_RING = "g AS (SELECT vec_id AS src, (vec_id + 1) % 500 AS dst FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, (vec_id * 7) % 500 FROM embeddings WHERE vec_id % 2 = 0)"


def ring(spark, d):
    v = vectors(spark, d)
    return v.filter("id % 3 <> 0").select(F.col("id").alias("src"), ((F.col("id") + 1) % 500).alias("dst")).union(v.filter("id % 2 = 0").select("id", (F.col("id") * 7) % 500))


@query(f"""WITH {_RING}, s AS (SELECT * FROM embeddings), x AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 / (1 + exp(-({_COS}))) AS probability FROM s a JOIN s b ON a.vec_id < b.vec_id)
SELECT src, dst, round(probability, 6) AS probability FROM x WHERE probability >= 0.5 AND NOT EXISTS (SELECT 1 FROM g WHERE g.src = x.src AND g.dst = x.dst) ORDER BY x.probability DESC, src, dst LIMIT 20""")
def link_candidates(spark, d):
    return rounded(insight.link_candidates(vectors(spark, d), ring(spark, d)), "probability")


_MEAN = f"""{_RING}, b AS (SELECT src AS id, dst AS n FROM g UNION ALL SELECT dst, src FROM g),
c AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings), f AS (SELECT id, i, embedding[i]::DOUBLE AS x FROM c),
m AS (SELECT b.id, f.i, avg(f.x) AS m FROM b JOIN f ON f.id = b.n GROUP BY ALL),
r AS (SELECT v.vec_id AS id, coalesce(sqrt(sum((f.x - m.m) * (f.x - m.m))), 0) AS error FROM embeddings v LEFT JOIN m ON m.id = v.vec_id LEFT JOIN f ON f.id = m.id AND f.i = m.i GROUP BY v.vec_id)"""


@query(f"WITH {_MEAN} SELECT id, round(error, 5) AS error, round((error - (SELECT avg(error) FROM r)) / (SELECT stddev_pop(error) FROM r), 4) AS z FROM r")
def neighbor_mean_anomaly(spark, d):
    return rounded(rounded(insight.neighbour_anomaly(vectors(spark, d).select("id", "embedding"), ring(spark, d)), "error", places=5), "z", places=4)


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer")
def zscore(spark, d):
    return rounded(vector.z_score(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "z").select("c_custkey", "z"), "z")


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) - min(c_acctbal) FROM customer) + 1e-9), 6) AS scaled FROM customer")
def minmax(spark, d):
    return rounded(vector.min_max(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "scaled").select("c_custkey", "scaled"), "scaled")


_NORM = lambda c: f"({c} - (SELECT min({c}) FROM s)) / ((SELECT max({c}) - min({c}) FROM s) + 1e-9)"


@query(f"""WITH s AS (SELECT s_suppkey AS id, s_acctbal AS n, (s_suppkey % 7)::DOUBLE AS p, (s_suppkey % 5)::DOUBLE AS b, s_nationkey::DOUBLE AS g FROM supplier),
t AS (SELECT id, 0.2 * {_NORM("n")} + 0.4 * {_NORM("p")} + 0.2 * {_NORM("b")} + 0.2 * {_NORM("g")} AS v FROM s)
SELECT id, round((v - (SELECT min(v) FROM t)) / ((SELECT max(v) - min(v) FROM t) + 1e-9), 6) AS importance FROM t""")
def importance(spark, d):
    s = t(spark, d, "supplier")
    k = F.col("s_suppkey")
    s = s.select(k.alias("id"), F.col("s_acctbal").alias("embedding_norm"), (k % 7).cast("double").alias("pagerank"), (k % 5).cast("double").alias("betweenness"), F.col("s_nationkey").cast("double").alias("degree"))
    return rounded(insight.importance(s), "importance")


@query(f"""WITH {_RING}, b AS (SELECT DISTINCT src AS i, dst AS n FROM g UNION SELECT dst, src FROM g UNION SELECT vec_id, vec_id FROM embeddings), k AS (SELECT i, count(*) AS k FROM b GROUP BY i),
x AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS j, embedding FROM embeddings)
SELECT b.i AS id, x.j - 1 AS dim, round(sum(x.embedding[x.j]::DOUBLE / sqrt(p.k * q.k)), 5) AS value FROM b JOIN k p ON p.i = b.i JOIN k q ON q.i = b.n JOIN x ON x.id = b.n GROUP BY ALL""")
def gcn_propagate(spark, d):
    out = network.gcn_propagate(vectors(spark, d).select("id", "embedding"), ring(spark, d))
    return rounded(longs(out.select("id", F.posexplode("embedding").alias("dim", "value")), "dim"), "value", places=5)


@query(f"""WITH {_RING}, x AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS j, embedding FROM embeddings), y AS (SELECT id, j - 1 AS dim, embedding[j]::DOUBLE AS a FROM x)
SELECT g.dst AS id, y.dim, round(avg(y.a), 6) AS mean, round(max(y.a), 6) AS max, round(sum(y.a), 6) AS sum FROM g JOIN y ON y.id = g.src GROUP BY ALL""")
def neighbour_aggregates(spark, d):
    near = ring(spark, d).join(vectors(spark, d).select(F.col("id").alias("src"), F.col("embedding").alias("v")), "src").select(F.col("dst").alias("id"), "v")
    parts = [vector.vector_sum(near, "id", "v", how=h).select("id", F.posexplode("v").alias("dim", h)).withColumn(h, F.round(h, 6)) for h in ("mean", "max", "sum")]
    return longs(parts[0].join(parts[1], ["id", "dim"]).join(parts[2], ["id", "dim"]), "dim")


@query(f"""WITH {_RING}, x AS (SELECT DISTINCT src, dst FROM g),
s AS (SELECT x.src, x.dst, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(len(a.embedding)) AS s FROM x JOIN embeddings a ON a.vec_id = x.src JOIN embeddings b ON b.vec_id = x.dst)
SELECT src, dst, round(exp(s) / sum(exp(s)) OVER (PARTITION BY dst), 6) AS weight FROM s""")
def gat_attention(spark, d):
    return rounded(network.attention(vectors(spark, d).select("id", "embedding"), ring(spark, d)), "weight")


@query("""WITH s AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer)
SELECT c_custkey, round((c_acctbal - m1) / s1, 6) AS c_acctbal, round((c_nationkey - m2) / s2, 6) AS c_nationkey, 0.0::DOUBLE AS one FROM customer, s""")
def standard_scaling(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), F.lit(3.0).alias("one"))
    return rounded(vector.standard_scale(c, ["c_acctbal", "c_nationkey", "one"]), "c_acctbal", "c_nationkey")


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norms(spark, d):
    return vectors(spark, d).select("id", F.round(vector.norm(F.col("embedding")), 5).alias("norm"))


@graph_query()
def neighbour_sample(v, e):
    return graph.sample_neighbours(e, v.filter("id like 'r%'"))


@graph_query(f"""WITH RECURSIVE {EDGES}{_LABELS}, u AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM e WHERE src <> dst),
g AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM u UNION ALL SELECT y FROM u) GROUP BY id),
z AS (SELECT p.x AS i, p.y AS j, q.y AS k FROM u p JOIN u q ON p.y = q.x JOIN u r ON r.x = p.x AND r.y = q.y),
c AS (SELECT id, count(*) AS n FROM (SELECT i AS id FROM z UNION ALL SELECT j FROM z UNION ALL SELECT k FROM z) GROUP BY id),
r AS (SELECT id, id AS c FROM v UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.id), o AS (SELECT id, min(c) AS c FROM r GROUP BY id),
big AS (SELECT c, count(*) AS n FROM o GROUP BY c ORDER BY n DESC, c LIMIT 1),
h AS (SELECT id AS s, id AS t, 0 AS d, 0 AS k FROM o JOIN big USING (c) WHERE big.n >= 2 UNION ALL SELECT s, t, min(d), k + 1 FROM
  (SELECT s, t, d, k FROM h UNION ALL SELECT h.s, b.dst, h.k + 1, h.k FROM h JOIN b ON b.src = h.t WHERE h.d = h.k) GROUP BY s, t, k HAVING min(d) >= k),
n AS (SELECT (SELECT count(*) FROM v)::DOUBLE AS n, (SELECT count(*) FROM e)::DOUBLE AS m)
SELECT 'n_nodes' AS statistic, n AS value FROM n UNION ALL SELECT 'n_edges', m FROM n UNION ALL SELECT 'avg_degree', round(2 * m / n, 6) FROM n
UNION ALL SELECT 'density', round(m / (n * (n - 1)), 6) FROM n UNION ALL SELECT 'n_components', count(DISTINCT c) FROM o
UNION ALL SELECT 'avg_clustering', round(avg(CASE WHEN g.n > 1 THEN 2.0 * coalesce(c.n, 0) / (g.n * (g.n - 1)) ELSE 0 END), 6) FROM v LEFT JOIN g USING (id) LEFT JOIN c USING (id)
UNION ALL SELECT 'diameter', coalesce((SELECT max(d) FROM h), -1) UNION ALL SELECT 'n_communities', count(DISTINCT community) FROM l5""")
def graph_statistics(v, e):
    row = {k: round(x, 6) for k, x in graph.statistics(v, e, graph.label_propagation(v, e, rounds=5), most=None).items()}
    return v.sparkSession.createDataFrame([(k, float(x)) for k, x in row.items()], "statistic string, value double")


@graph_query()
def graph_layouts(v, e):
    rows = [(name, i, *map(float, p)) for name, f in (("spring", graph.spring_layout), ("kamada_kawai", graph.kamada_kawai_layout)) for i, p in f(v, e).items()]
    flat = graph.hierarchical_layout(graph.hierarchy(v, e).join(graph.label_propagation(v, e, 2).withColumn("community", F.length("community")), "id"))
    return v.sparkSession.createDataFrame(rows, "layout string, id string, x double, y double").unionByName(flat.select(F.lit("hierarchical").alias("layout"), "id", "x", "y"))


@graph_query()
def gnn_train(v, e):
    v = v.filter("id not like 's%'")
    deg = graph.degrees(v, e)
    kind = [(F.substring("id", 1, 1) == k).cast("double") for k in "cnrp"]
    config = EngineConfig(training=Training(epochs=10, rate=0.01), network=Network(hidden=16, out=8))
    trainer, _ = network.train_graph(v, e, deg.select("id", F.array(*kind, F.log1p("degree")).alias("features")), config)
    return trainer.train().table(v.sparkSession)


@query()
def ward_entities(spark, d):
    found, _ = entities.discover(readers.synthetic_erp(spark, 300), ["order_id"])
    return spark.createDataFrame([(x["name"], x["type"], x["columns"], x["confidence"], x["representative"]) for x in found], "name string, type string, columns array<string>, confidence double, representative string")


@query()
def discovered_relations(spark, d):
    df = readers.synthetic_erp(spark, 300)
    found, types = entities.discover(df, ["order_id"])
    rows = [(r["source"], r["target"], r["name"], r["type"], r["confidence"], r["cardinality"]) for r in relations.discover(df, found, types)]
    return spark.createDataFrame(rows, "source string, target string, name string, type string, confidence double, cardinality string")


_ALONG = """coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING),
  first_value({c} IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"""WITH {DIRTY}, c AS (SELECT idx, CASE WHEN lower(trim(status)) = 'nan' THEN NULL ELSE trim(status) END AS status, try_cast(trim(cents) AS DOUBLE) AS cents,
  coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%Y%m%d')) AS day,
  CASE WHEN lower(trim(flag)) IN ('1', 'true', 'yes') THEN true WHEN lower(trim(flag)) IN ('0', 'false', 'no') THEN false END AS flag, trim(note) AS note, ts FROM d),
m AS (SELECT status FROM c WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)
SELECT idx, coalesce(status, (SELECT status FROM m)) AS status, coalesce(cents, (SELECT median(cents) FROM c)) AS cents, strftime({_ALONG.format(c="day")}, '%Y-%m-%d') AS day,
  flag, coalesce(note, '') AS note, strftime({_ALONG.format(c="ts")}, '%Y-%m-%d') AS ts FROM c""")
def cleaned_table(spark, d):
    out = clean.clean(dirty(spark, d), {"status": "categorical", "cents": "numeric", "day": "datetime", "flag": "boolean", "note": "text", "ts": "datetime"}, "idx")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("day", "ts")})


@graph_query(f"""WITH {EDGES} SELECT '{{"group":"nodes","data":{{"id":"' || id || '"}}}}' AS element FROM v
UNION ALL SELECT '{{"group":"edges","data":{{"id":"' || src || '__' || dst || '","source":"' || src || '","target":"' || dst || '","weight":' || CAST(weight AS VARCHAR) || '}}}}' FROM e""")
def cytoscape_export(v, e):
    return writers.cytoscape_elements(v, e)


@query("SELECT row_number() OVER (ORDER BY o_orderkey)::BIGINT AS place, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50000")
def row_cap(spark, d):
    from pyspark.sql import Window

    config = EngineConfig(ingestion=Ingestion(max_rows=50_000))
    first = readers.load(spark, f"{d}/orders.parquet", config, order=["o_orderkey"]).select("o_orderkey")
    return first.withColumn("place", F.row_number().over(Window.orderBy("o_orderkey")).cast("long"))


# --- sources ----------------------------------------------------------------------------------------------------------

_LOADED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"


def _loaded(spark: SparkSession, d: str, suffix: str, form: str, **options: str) -> DataFrame:
    """Orders, written in a format and read back by the suffix."""
    path = f"{new_path(spark)}{suffix}"
    t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").write.format(form).options(**options).save(path)
    forget_at_exit(spark, path)
    return longs(readers.load(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", "o_custkey")


@query(_LOADED)
def load_csv(spark, d):
    return _loaded(spark, d, ".csv", "csv", header="true")


@query(_LOADED)
def load_tsv(spark, d):
    return _loaded(spark, d, ".tsv", "csv", header="true", sep="\t")


@query(_LOADED)
def load_jsonl(spark, d):
    return _loaded(spark, d, ".jsonl", "json")


@query(_LOADED)
def load_parquet(spark, d):
    return _loaded(spark, d, ".parquet", "parquet")


@query(_LOADED)
def load_xml(spark, d):
    return _loaded(spark, d, ".xml", "xml", rootTag="orders", rowTag="order")


# --- insight ----------------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey::BIGINT AS community, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def community_summary(spark, d):
    return insight.community_summary(t(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("community"), F.col("n_name").alias("entity_name")))


@query("SELECT s_suppkey AS id, round((s_suppkey % 9) / 30, 4) AS betweenness, s_suppkey % 3 AS out_degree FROM supplier WHERE (s_suppkey % 9) / 30 > 0.1 AND s_suppkey % 3 <= 1")
def bottlenecks(spark, d):
    k = F.col("s_suppkey")
    return insight.bottlenecks(t(spark, d, "supplier").select(k.alias("id"), ((k % 9) / 30).alias("betweenness"), (k % 3).alias("out_degree")))


@graph_query(f"""WITH {EDGES}, n AS (SELECT (SELECT count(*) FROM v)::DOUBLE AS n, (SELECT count(*) FROM e)::DOUBLE AS m)
SELECT round(0.4 * least(m / n, 1) + 0.4 * least(9 / n, 1) + 0.2 * greatest(0, 1 - 4 / n), 4) AS health FROM n""")
def graph_health(v, e):
    r = graph.density(v, e).first()
    return v.sparkSession.createDataFrame([(insight.health(r["n_nodes"], r["n_edges"], 9, r["n_nodes"], 4),)], "health double")


@graph_query(f"WITH {EDGES} SELECT src, " + ", ".join(f"coalesce(max(weight) FILTER (dst = 'p{i}'), 0) AS p{i}" for i in range(1, 6)) + " FROM e WHERE dst LIKE 'p%' GROUP BY src")
def relationship_matrix(v, e):
    return insight.relationship_matrix(e.filter("dst like 'p%'"), [f"p{i}" for i in range(1, 6)])


# --- stream -----------------------------------------------------------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most
FROM events GROUP BY ALL""")
def events_hourly(spark, d):
    return stream.hourly(t(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a profile of the orders table."""
    return profile.column_profile(t(spark, sf_dir, "orders"), ["o_orderkey"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
