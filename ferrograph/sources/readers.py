"""Tables from files, by suffix, and from memory."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrograph.config import EngineConfig
from ferrograph.errors import DataError
from ferrograph.plans.store import ship

_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(*suffixes: str):
    """Register a reader; others may add their own."""

    def add(f):
        _READERS.update({s: f for s in suffixes})
        return f

    return add


def load(spark: SparkSession, source, config: EngineConfig | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A table from a path (by suffix), a dict (one row, or columns if its first value is a list), a list of dicts, a
    pandas table or a DataFrame. If the settings have `max_rows`, a file gives that many rows at most: the first by the
    columns of `order`, or any."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, pd.DataFrame):
        return spark.createDataFrame(source)
    if isinstance(source, dict):
        first = next(iter(source.values()), None)
        return spark.createDataFrame(pd.DataFrame(source if isinstance(first, list) else [source]))
    if isinstance(source, list):
        return spark.createDataFrame(pd.DataFrame(source))
    ingestion = (config or EngineConfig()).ingestion
    suffix = posixpath.splitext(str(source).lower())[1]
    if suffix not in _READERS:
        raise DataError("no reader for this kind of file", path=str(source), known=sorted(_READERS))
    try:
        more = {"multiline": True} if suffix == ".csv" and ingestion.csv_multiline else {}
        df = _READERS[suffix](spark, str(source), **more)
    except DataError:
        raise
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise DataError("there is no such file", path=str(source)) from e
        raise DataError("the file can't be read", path=str(source), cause=str(e)[:200]) from e
    if not ingestion.max_rows:
        return df
    return (df.orderBy(*order) if order else df).limit(ingestion.max_rows)


@reader(".csv")
def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=multiline, escape='"')


@reader(".tsv")
def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t")


@reader(".parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader(".jsonl", ".ndjson")
def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


@reader(".json")
def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, columns as lists, or one record."""
    df = spark.read.json(path, multiLine=True)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if arrays and len(arrays) == len(df.columns):
        return df.select(F.explode(F.arrays_zip(*(F.col(c) for c in df.columns))).alias("r")).select(*(F.col("r").getField(c).alias(c) for c in df.columns))
    return df


@reader(".xml")
def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Each child of the root is a row: its elements' texts, and its attributes, which win."""
    head = spark.read.text(path).filter(F.col("value").contains("<")).limit(50).collect()
    tags = re.findall(r"<([A-Za-z_][\w.-]*)", re.sub(r"<[?!][^>]*>", "", "\n".join(r[0] for r in head)))
    if len(tags) < 2:
        raise DataError("the XML file has no rows", path=path)
    df = spark.read.format("xml").option("rowTag", tags[1]).option("inferSchema", "false").load(path)
    own = [c for c in df.columns if c.startswith("_") and c != "_VALUE"]
    plain = [F.col(c) for c in df.columns if not c.startswith("_") and "_" + c not in own]
    return df.select(*plain, *(F.col(c).alias(c[1:]) for c in own))


@reader(".xlsx")
def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, read from its zipped XML on an executor; columns are typed as in CSV."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield pd.DataFrame({"line": [_csv_line(r) for r in sheet_rows(bytes(content))]})

    lines = files.mapInPandas(run, "line string")
    text = [r["line"] for r in lines.collect()]  # a workbook is one file of bounded size (a million rows)
    if not text:
        raise DataError("the sheet is empty", path=path)
    return spark.read.csv(spark.sparkContext.parallelize(text), header=True, inferSchema=True, escape='"')


def _csv_line(row: list[str | None]) -> str:
    return ",".join("" if v is None else '"' + v.replace('"', '""') + '"' for v in row)


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text."""
    name = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if name(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in (e for e in ET.fromstring(z.read(sheet)).iter() if name(e) == "row"):
            cells: dict[int, str | None] = {}
            for c in row:
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                value = next((e.text for e in c.iter() if name(e) in ("v", "t")), None)
                cells[at] = shared[int(value)] if c.get("t") == "s" and value is not None else value
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


#: Values of the made-up table, by column.
CATEGORIES = ["Tools", "Garden", "Kitchen", "Paper", "Light", "Sound", "Sport"]
STATES = ["open", "packed", "sent", "closed", "returned"]
METHODS = ["card", "cash", "transfer", "cheque", "credit"]
TEAMS = ["East", "West", "Web", "Phone", "Export", "Service"]
AREAS = ["North", "South", "Centre", "Coast", "Islands"]


def synthetic_erp(spark: SparkSession, rows: int = 500, seed: int = 42) -> DataFrame:
    """A flat business table of 23 columns, the same for the same seed on any number of partitions."""
    i = F.col("id")
    h = lambda salt: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(1_000_003))
    unit = lambda salt: h(salt) / 1_000_003.0
    pick = lambda salt, n: (h(salt) % n).cast("long")
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    code = lambda p, k, n: F.concat(F.lit(p + "-"), F.lpad((k + 1).cast("string"), n, "0"))
    cust, prod, emp = pick("c", max(1, rows // 5)), pick("p", max(1, rows // 10)), pick("e", max(1, rows // 25))
    day = F.date_add(F.lit("2022-01-01").cast("date"), pick("d", 730).cast("int"))
    billed = F.date_add(day, (pick("b", 6) + 1).cast("int"))
    amount = F.round(10 + unit("a") * 4990, 2)
    of_product = F.pmod(F.xxhash64(prod, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return spark.range(rows).select(
        code("CUST", cust, 4).alias("customer_id"),
        F.concat(F.lit("Customer "), cust).alias("customer_name"),
        F.concat(F.lit("customer"), cust, F.lit("@example.com")).alias("customer_email"),
        F.format_string("+1-%03d-%04d", (h("f") % 1000).cast("int"), (h("g") % 10000).cast("int")).alias("customer_phone"),
        F.concat_ws(" ", (h("s") % 9999).cast("string"), of(AREAS, h("t")), F.lit("Street")).alias("customer_address"),
        code("ORD", i, 5).alias("order_id"),
        iso(day).alias("order_date"),
        amount.alias("order_amount"),
        of(STATES, h("o")).alias("order_status"),
        code("PROD", prod, 4).alias("product_id"),
        F.concat(of(CATEGORIES, prod), F.lit(" "), prod).alias("product_name"),
        of(CATEGORIES, prod).alias("product_category"),
        F.round(5 + of_product * 1995, 2).alias("product_price"),
        code("INV", i, 5).alias("invoice_id"),
        iso(billed).alias("invoice_date"),
        F.round(amount * (0.95 + 0.1 * unit("i")), 2).alias("invoice_amount"),
        code("PAY", i, 5).alias("payment_id"),
        iso(F.date_add(billed, pick("y", 30).cast("int"))).alias("payment_date"),
        of(METHODS, h("m")).alias("payment_method"),
        code("EMP", emp, 3).alias("employee_id"),
        F.concat(F.lit("Employee "), emp).alias("employee_name"),
        of(TEAMS, emp).alias("department"),
        of(AREAS, h("r")).alias("region"),
    )
