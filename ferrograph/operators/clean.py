"""Cleaning: drop, trim, coerce, fill, in this order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrograph.config import EngineConfig
from ferrograph.functions.text import to_boolean, to_number, to_time, trimmed
from ferrograph.operators import profile


def columns_to_drop(df: DataFrame, config: EngineConfig | None = None) -> list[str]:
    """Constant columns and those with too many nulls."""
    c = (config or EngineConfig()).ingestion
    rows = profile.missing_rate(df).join(profile.distinct_ratio(df), "column")
    return [r["column"] for r in rows.filter((F.col("n_distinct") <= c.constant_distinct) | (F.col("missing_rate") > c.missing_drop)).collect()]


def drop_columns(df: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    return df.drop(*columns_to_drop(df, config))


def trim_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: trimmed(F.col(c)) for c in names})


def coerce(df: DataFrame, types: dict[str, str], config: EngineConfig | None = None) -> DataFrame:
    """Columns by semantic type: numbers, times and truth values; what doesn't fit is null."""
    formats = (config or EngineConfig()).ingestion.date_formats
    change = {}
    for c, kind in types.items():
        if kind == "numeric":
            change[c] = to_number(F.col(c))
        elif kind == "datetime" and isinstance(df.schema[c].dataType, T.StringType):
            change[c] = to_time(F.col(c), formats)
        elif kind == "boolean":
            change[c] = to_boolean(F.col(c))
    return df.withColumns(change)


#: Rows of which a median is taken by one aggregate, which keeps all their distinct values.
ONE_BUFFER = 1_000_000


def medians(df: DataFrame, columns: Sequence[str], most: int = ONE_BUFFER) -> dict[str, float | None]:
    """The exact median of each column, without nulls and NaN (None if nothing is left).

    Of more than `most` rows, sketched quantiles bracket the middle ranks; what lies outside is counted only, and the
    bracket is narrowed until an aggregate can hold it or one value fills it.
    """
    xs = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    sizes = df.agg(*(F.count(x).alias(c) for c, x in xs.items())).first()
    few = [c for c in columns if sizes[c] <= most]
    out = df.agg(*(F.median(xs[c]).alias(c) for c in few)).first().asDict() if few else {}
    for c in columns:
        if c not in out:
            part, n = df.select(xs[c].alias("x")).filter("x is not null"), sizes[c]
            middle = [_kth(part, n, k, most) for k in sorted({(n - 1) // 2, n // 2})]
            out[c] = sum(middle) / len(middle)
    return out


def _kth(part: DataFrame, n: int, k: int, most: int) -> float:
    """The k-th smallest (from 0) of the n rows x of `part`."""
    x, slack = F.col("x"), 0.01
    while n > most:
        low, high = part.approxQuantile("x", [max(0.0, k / n - slack), min(1.0, k / n + slack)], slack / 4)
        seen = part.agg(
            F.count_if(x < low).alias("below"),
            F.count_if(x == low).alias("low"),
            F.count_if((x > low) & (x < high)).alias("between"),
            F.count_if((x == high) & (x > low)).alias("high"),
        ).first()
        at = k - seen["below"]
        if not 0 <= at < seen["low"] + seen["between"] + seen["high"]:
            slack *= 2
        elif at < seen["low"]:
            return low
        elif at >= seen["low"] + seen["between"]:
            return high
        else:
            part, n, k = part.filter((x > low) & (x < high)), seen["between"], at - seen["low"]
    return part.agg(F.sort_array(F.collect_list("x"))[k].alias("x")).first()["x"]


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    middle = medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double")) for c in columns})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """With the most frequent value, the smallest of several; UNKNOWN if there is none."""
    modes = {r["column"]: r["mode"] for r in profile.mode_value(profile.value_counts(df, columns)).collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c, "UNKNOWN"))) for c in columns})


def fill_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def fill_along(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Nulls take the last value before them in the order of a column, or else the next after.

    The order is global, but no task holds it all: rows are cut into ranges of the order, each range
    fills itself, and the ends of the ranges (one row each) carry values over its borders. Both windows end at the row
    itself, so each is one pass over its sorted range. Rows without an order come first.
    """
    # a fixed number of ranges by quantiles of the order column
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01) if ranges > 1 else []
    bucket = F.lit(0)
    for cut in sorted(set(cuts)):
        bucket = bucket + F.when(F.col(order) > cut, 1).otherwise(0)
    cut_up = df.withColumn("_r", bucket)
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    ends = cut_up.groupBy("_r").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_l_{c}") for c in columns),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_f_{c}") for c in columns),
    )
    up = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        "_r",
        *(F.last(f"_l_{c}", ignorenulls=True).over(up).alias(f"_b_{c}") for c in columns),
        *(F.first(f"_f_{c}", ignorenulls=True).over(down).alias(f"_a_{c}") for c in columns),
    )
    before = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_r").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut_up.join(F.broadcast(carried), "_r")
    return out.select(
        *(
            F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(f"_b_{c}"), F.last(c, ignorenulls=True).over(after), F.col(f"_a_{c}")).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        )
    )


def clean(df: DataFrame, types: dict[str, str], order: str, config: EngineConfig | None = None) -> DataFrame:
    """Drop useless columns, trim, coerce by semantic type, fill by semantic type."""
    config = config or EngineConfig()
    if config.ingestion.drop_duplicates:
        df = df.dropDuplicates()
    df = trim_strings(df.drop(*(c for c in columns_to_drop(df, config) if c != order)))
    types = {c: t for c, t in types.items() if c in df.columns and c != order}
    df = coerce(df, types, config)
    by = lambda *kinds: [c for c, t in types.items() if t in kinds]
    for names, fill in ((by("numeric"), fill_median), (by("categorical", "id"), fill_mode), (by("text"), fill_text)):
        if names:
            df = fill(df, names)
    return fill_along(df, by("datetime"), order) if by("datetime") else df
