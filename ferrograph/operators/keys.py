"""Keys and overlaps between columns, on the distinct (column, value) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrograph.functions.text import is_uuid
from ferrograph.operators import profile
from ferrograph.plans.store import saved

# Parts of a column's name that hint at an identifier.
ID_HINTS = ("_id", "id_", "_key", "_code", "_num")


def value_sets(df: DataFrame, columns: Sequence[str], sample_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Distinct (column, value); of a seeded sample of rows if wanted, by hash."""
    if sample_rows:
        df = df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(sample_rows)
    return profile.value_counts(df, columns).select("column", "value")


def pair_columns(types: dict[str, str], boolean: bool = False, most: int | None = 30) -> list[str]:
    """Identifier and category columns (truth values too for overlaps), the first `most` of them."""
    kinds = ("id", "categorical", "boolean") if boolean else ("id", "categorical")
    return [c for c, t in types.items() if t in kinds][:most]


def overlaps(sets: DataFrame) -> DataFrame:
    """col_a < col_b with n_a, n_b and n_both: a self-join on the value, counted by pair."""
    size = sets.groupBy("column").agg(F.count("*").alias("n"))
    a, b = sets.select(F.col("column").alias("col_a"), "value"), sets.select(F.col("column").alias("col_b"), "value")
    both = a.join(b, "value").filter("col_a < col_b").groupBy("col_a", "col_b").agg(F.count("*").alias("n_both"))
    pairs = size.select(F.col("column").alias("col_a"), F.col("n").alias("n_a")).crossJoin(
        F.broadcast(size.select(F.col("column").alias("col_b"), F.col("n").alias("n_b")))
    )
    return pairs.filter("col_a < col_b").join(both, ["col_a", "col_b"], "left").fillna(0, ["n_both"])


def jaccard_overlap(sets: DataFrame) -> DataFrame:
    """col_a, col_b, jaccard."""
    return overlaps(sets).select("col_a", "col_b", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"))


def fk_pairs(sets: DataFrame, least: float = 0.6) -> DataFrame:
    """child_col, parent_col, overlap: the smaller set's share inside the larger one, over `least`."""
    both = overlaps(sets).filter("n_a <> n_b")
    child = F.least("n_a", "n_b")
    return both.select(
        F.when(F.col("n_a") < F.col("n_b"), F.col("col_a")).otherwise(F.col("col_b")).alias("child_col"),
        F.when(F.col("n_a") < F.col("n_b"), F.col("col_b")).otherwise(F.col("col_a")).alias("parent_col"),
        (F.col("n_both") / child).alias("overlap"),
    ).filter(F.col("overlap") > least)


def cardinality(df: DataFrame, a: str, b: str) -> DataFrame:
    """avg_a_per_b, avg_b_per_a and the cardinality they mean."""
    pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()
    per_b = pairs.groupBy("b").count().agg(F.avg("count").alias("avg_a_per_b"))
    per_a = pairs.groupBy("a").count().agg(F.avg("count").alias("avg_b_per_a"))
    return per_b.crossJoin(per_a).select(
        "avg_a_per_b",
        "avg_b_per_a",
        F.when((F.col("avg_a_per_b") <= 1.1) & (F.col("avg_b_per_a") <= 1.1), "1:1")
        .when(F.col("avg_b_per_a") > 1.5, "N:N")
        .otherwise("1:N")
        .alias("cardinality"),
    )


def sequential_share(df: DataFrame, column: str, order: Sequence[str], k: int = 50) -> DataFrame:
    """column, share: of the first k whole numbers, sorted, how many differ by one from the one before."""
    n = profile.first_values(df, column, order, k).select("column", F.col("value").try_cast("bigint").alias("v")).filter("v is not null")
    step = n.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("column").orderBy("v")))
    return step.groupBy("column").agg(F.coalesce(F.try_divide(F.count_if(F.col("d") == 1), F.count("d")), F.lit(0.0)).alias("share"))


def uuid_share(df: DataFrame, column: str, order: Sequence[str], k: int = 50) -> DataFrame:
    """column, share of its first k values that are UUIDs."""
    return profile.first_values(df, column, order, k).groupBy("column").agg(F.avg(is_uuid(F.col("value")).cast("int")).alias("share"))


def id_columns(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, ratio: float = 0.95, distinct: DataFrame | None = None) -> DataFrame:
    """column, is_id: unique values or a telling name, and then UUIDs, a sequence, or both of the first two. One sample of
    each column serves both tests.

    distinct: the columns' unique_ratio, if they are known.
    """
    columns = list(columns or df.columns)
    some = None
    for c in columns:
        one = profile.first_values(df, c, order, 50)
        some = one if some is None else some.unionAll(one)
    number = F.col("value").try_cast("bigint")
    step = number - F.lag(number).over(Window.partitionBy("column").orderBy(number.asc_nulls_last()))
    shares = some.withColumn("d", step).groupBy("column").agg(
        F.coalesce(F.try_divide(F.count_if(F.col("d") == 1), F.count("d")), F.lit(0.0)).alias("seq"), F.avg(is_uuid(F.col("value")).cast("int")).alias("uuid")
    )
    out = (profile.distinct_ratio(df, columns) if distinct is None else distinct).join(F.broadcast(shares), "column", "left")
    hint = F.lit(False)
    for h in ID_HINTS:
        hint = hint | F.contains(F.lower("column"), F.lit(h))
    unique = F.col("unique_ratio") > ratio
    return out.select(
        "column",
        ((unique | hint) & ((F.coalesce("uuid", F.lit(0.0)) > 0.8) | (F.coalesce("seq", F.lit(0.0)) > 0.6) | (hint & (F.col("unique_ratio") > 0.5)))).alias("is_id"),
    )


def primary_keys(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """column: identifiers that are nearly unique."""
    distinct = saved(profile.distinct_ratio(df, columns))
    ids = id_columns(df, order, columns, distinct=distinct).filter("is_id")
    return ids.join(F.broadcast(distinct), "column").filter("unique_ratio > 0.9").select("column")
