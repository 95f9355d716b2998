"""Column profiles: quality, statistics and semantic types, one row per column.

Scalar statistics of all columns come from one aggregation. What needs the values (distinct counts, modes,
entropy, frequent values) comes from one table of value counts, itself pre-aggregated before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrograph.config import EngineConfig
from ferrograph.functions.text import to_time, token_count
from ferrograph.plans.store import forget, saved

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TYPES = ("numeric", "categorical", "datetime", "boolean", "text", "id")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def present(df: DataFrame, column: str) -> Column:
    """The column, with NaN as null."""
    kind = df.schema[column].dataType
    return F.when(~F.isnan(df[column]), df[column]) if isinstance(kind, (T.FloatType, T.DoubleType)) else df[column]


def _long(df: DataFrame, columns: Sequence[str], fields: dict) -> DataFrame:
    """One aggregation over `df`, turned into a row per column. fields: name -> function from a column's name to an aggregate."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(f(c).alias(n) for n, f in fields.items())) for c in columns))
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def missing_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_rows, n_missing, missing_rate."""
    out = _long(
        df,
        columns or df.columns,
        {"n_rows": lambda c: F.count(F.lit(1)), "n_missing": lambda c: F.count_if(present(df, c).isNull())},
    )
    return out.withColumn("missing_rate", F.col("n_missing") / F.greatest("n_rows", F.lit(1)))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, value (as text), n: how often each non-null value is found."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in columns or df.columns))
    long = df.select(F.explode(cells).alias("x")).select("x.column", "x.value").filter("value is not null")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_ratio(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """column, n_distinct, unique_ratio (distinct values by rows); approximate counts by a sketch if wanted."""
    columns = list(columns or df.columns)
    if approximate:
        out = _long(df, columns, {"n_distinct": lambda c: F.approx_count_distinct(present(df, c)), "n_rows": lambda c: F.count(F.lit(1))})
    else:
        n = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n_distinct"))
        out = missing_rate(df, columns).select("column", "n_rows").join(F.broadcast(n), "column", "left").fillna(0, ["n_distinct"])
    return out.select("column", "n_distinct", (F.col("n_distinct") / F.greatest("n_rows", F.lit(1))).alias("unique_ratio"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, n_duplicates: rows that are equal to an earlier one."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None, most: int = 1) -> DataFrame:
    return distinct_ratio(df, columns).filter(F.col("n_distinct") <= most).select("column", "n_distinct")


def high_cardinality(df: DataFrame, columns: Sequence[str] | None = None, ratio: float = 0.95) -> DataFrame:
    return distinct_ratio(df, columns).filter(F.col("unique_ratio") > ratio).select("column", "n_distinct", "unique_ratio")


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, mean, std (sample), min, max, norm_mean (mean by range), cv (std by mean)."""
    x = lambda c: present(df, c).cast("double")
    out = _long(
        df,
        columns or numeric_columns(df),
        {"mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)), "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c))},
    ).fillna(0.0, ["mean", "std", "min", "max"])
    width = F.col("max") - F.col("min")
    return out.withColumn("norm_mean", F.when(width > 0, F.col("mean") / (width + 1e-9)).otherwise(0.0)).withColumn(
        "cv", F.col("std") / (F.abs("mean") + 1e-9)
    )


def avg_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, avg_tokens: words of its non-null values."""
    return _long(df, columns, {"avg_tokens": lambda c: F.coalesce(F.avg(token_count(df[c])), F.lit(0.0))})


def topk_freq(counts: DataFrame, k: int = 3) -> DataFrame:
    """column, place (1..k), freq: shares of the most frequent values, zero where there are fewer. From value counts."""
    total = counts.groupBy("column").agg(F.sum("n").alias("all"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    grid = total.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return grid.join(top.select("column", "place", "n"), ["column", "place"], "left").select(
        "column", "place", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("freq")
    )


def mode_value(counts: DataFrame) -> DataFrame:
    """column, mode: its most frequent value, the smallest of several."""
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), F.max("n").alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """column, entropy in nats of its values. From value counts: one pass, as ln(N) - sum(n ln n) / N."""
    out = counts.groupBy("column").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return out.select("column", F.greatest(F.log("all") - F.col("s") / F.col("all"), F.lit(0.0)).alias("entropy"))


def entropy_numeric(df: DataFrame, columns: Sequence[str], bins: int = 20, distinct: DataFrame | None = None) -> DataFrame:
    """column, entropy of the equal-width histogram with as many bins as values, `bins` at most; the last one is closed.

    distinct: the columns' n_distinct, if they are known.
    """
    distinct = distinct_ratio(df, columns) if distinct is None else distinct
    x = lambda c: present(df, c).cast("double")
    ends = _long(df, columns, {"lo": lambda c: F.min(x(c)), "hi": lambda c: F.max(x(c))})
    ends = ends.join(distinct.select("column", F.least("n_distinct", F.lit(bins)).alias("b")), "column")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), x(c).alias("v")) for c in columns))
    long = df.select(F.explode(cells).alias("x")).select("x.column", "x.v").filter("v is not null").join(F.broadcast(ends), "column")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("b")), F.col("b") - 1)).otherwise(0)
    return entropy(long.groupBy("column", place.cast("string").alias("value")).agg(F.count("*").alias("n")))


def first_values(df: DataFrame, column: str, order: Sequence[str], k: int = 100, width: int = 256) -> DataFrame:
    """The first k non-null values of a column, in the order of other columns: a top-k, not a sort of the table.

    Values are cut to `width` characters: what is tested on them (dates, truth values, UUIDs, numbers) is shorter.
    """
    value = F.substring(present(df, column).cast("string"), 1, width).alias("value")
    return df.filter(present(df, column).isNotNull()).orderBy(*order).limit(k).select(F.lit(column).alias("column"), value)


def semantic_types(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, config: EngineConfig | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """column, semantic_type. Checked in this order: boolean (of a sample; no value counts as one), numeric (physical
    type), datetime (over 80 % of the sample parse), id (unique), text (words), categorical.

    distinct: the columns' unique_ratio, if they are known.
    """
    c = (config or EngineConfig()).ingestion
    columns = list(columns or df.columns)
    sample = None
    for name in columns:
        one = first_values(df, name, order)
        sample = one if sample is None else sample.unionAll(one)
    yes = F.lower(F.trim("value")).isin("0", "1", "true", "false", "yes", "no")
    times = to_time(F.col("value"), [*c.date_formats, "yyyy-MM-dd HH:mm:ss"]).isNotNull()
    seen = sample.groupBy("column").agg(F.min(yes.cast("int")).alias("all_bool"), F.avg(times.cast("int")).alias("times"))
    kinds = {f.name: "numeric" if isinstance(f.dataType, NUMERIC) else "time" if "timestamp" in f.dataType.typeName() or f.dataType.typeName() == "date" else "other" for f in df.schema.fields}
    kind = F.create_map(*(F.lit(v) for k in columns for v in (k, kinds[k])))[F.col("column")]
    words = [k for k in columns if kinds[k] == "other"]
    out = (distinct_ratio(df, columns) if distinct is None else distinct).join(F.broadcast(seen), "column", "left")
    out = out.join(F.broadcast(avg_tokens(df, words)), "column", "left") if words else out.withColumn("avg_tokens", F.lit(0.0))
    return out.select(
        "column",
        F.when(F.coalesce("all_bool", F.lit(1)) == 1, "boolean")
        .when(kind == "numeric", "numeric")
        .when((kind == "time") | (F.col("times") > 0.8), "datetime")
        .when(F.col("unique_ratio") > c.id_uniqueness, "id")
        .when(F.coalesce("avg_tokens", F.lit(0.0)) > c.text_tokens, "text")
        .otherwise("categorical")
        .alias("semantic_type"),
    )


def column_profile(df: DataFrame, order: Sequence[str], config: EngineConfig | None = None) -> DataFrame:
    """All of a column's statistics and its semantic type, one row per column.

    The value counts are one table, written once: distinct counts, entropy and frequent values read it.
    """
    k = (config or EngineConfig()).features
    counts = saved(value_counts(df))
    n = counts.groupBy("column").agg(F.count("*").alias("n_distinct"))
    distinct = missing_rate(df).select("column", "n_rows").join(F.broadcast(n), "column", "left").fillna(0, ["n_distinct"])
    distinct = saved(distinct.select("column", "n_distinct", (F.col("n_distinct") / F.greatest("n_rows", F.lit(1))).alias("unique_ratio")))
    numbers = numeric_columns(df)
    words = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    top = topk_freq(counts, k.top_k).groupBy("column").pivot("place", list(range(1, k.top_k + 1))).agg(F.first("freq"))
    top = top.select("column", *(F.col(str(i)).alias(f"top{i}") for i in range(1, k.top_k + 1)))
    bits = entropy(counts.filter(~F.col("column").isin(numbers))) if numbers else entropy(counts)
    if numbers:
        bits = bits.unionByName(entropy_numeric(df, numbers, k.entropy_bins, distinct))
    out = missing_rate(df).join(distinct, "column")
    out = out.join(numeric_stats(df, numbers), "column", "left") if numbers else out
    out = out.join(avg_tokens(df, words), "column", "left") if words else out.withColumn("avg_tokens", F.lit(0.0))
    out = out.join(bits, "column", "left").join(top, "column", "left").join(semantic_types(df, order, config=config, distinct=distinct), "column", "left").fillna(0.0)
    done = saved(out)  # a row per column; the counts are as large as the table, and go
    forget(counts)
    return done


def quality_summary(profile: DataFrame, config: EngineConfig | None = None) -> str:
    """The profile as text; names columns with over 5 % missing."""
    c = (config or EngineConfig()).ingestion
    rows = profile.orderBy("column").collect()
    lines = [f"rows: {rows[0]['n_rows'] if rows else 0}, columns: {len(rows)}"]
    lines += [f"missing {r['missing_rate']:.1%}: {r['column']}" for r in rows if r["missing_rate"] > 0.05]
    drop = [r["column"] for r in rows if r["n_distinct"] <= c.constant_distinct or r["missing_rate"] > c.missing_drop]
    return "\n".join([*lines, f"to drop: {', '.join(drop) or 'none'}"])


def schema_summary(types: DataFrame, primary_keys: DataFrame, fk_pairs: DataFrame) -> str:
    """Columns by semantic type, keys and foreign keys, as text."""
    by: dict[str, list[str]] = {}
    for r in types.orderBy("column").collect():
        by.setdefault(r["semantic_type"], []).append(r["column"])
    lines = [f"{t}: {', '.join(by[t])}" for t in TYPES if t in by]
    lines += [f"key: {r['column']}" for r in primary_keys.orderBy("column").collect()]
    lines += [f"{r['child_col']} -> {r['parent_col']} ({r['overlap']:.2f})" for r in fk_pairs.orderBy("child_col", "parent_col").collect()]
    return "\n".join(lines)
