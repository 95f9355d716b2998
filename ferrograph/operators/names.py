"""Similarity of column names: TF-IDF over words and pairs of words, and cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.functions.text import name_tokens


def tokens(columns: DataFrame) -> DataFrame:
    """column, place (from 0), token, of a table with a column `column`."""
    return columns.select("column", F.posexplode(name_tokens(F.col("column"))).alias("place", "token"))


def terms(columns: DataFrame) -> DataFrame:
    """column, term: words of two characters or more, and pairs of neighbours among them."""
    words = F.filter(name_tokens(F.col("column")), lambda t: F.length(t) >= 2)
    two = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    two = F.when(F.size(words) >= 2, two).otherwise(F.array().cast("array<string>"))
    return columns.select("column", F.explode(F.concat(words, two)).alias("term"))


def tfidf(columns: DataFrame, features: int = 512) -> DataFrame:
    """column, term, weight: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), scaled to length one."""
    count = terms(columns).groupBy("column", "term").agg(F.count("*").alias("tf"))
    n = columns.select(F.countDistinct("column").alias("n_cols"))
    freq = count.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    freq = freq.orderBy(F.desc("all"), "term").limit(features).crossJoin(F.broadcast(n))
    w = count.join(F.broadcast(freq), "term").select(
        "column", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n_cols")) / (1 + F.col("df"))) + 1)).alias("w")
    )
    length = w.groupBy("column").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(length, "column").select("column", "term", (F.col("w") / F.col("len")).alias("weight"))


def cosines(weights: DataFrame) -> DataFrame:
    """col_a < col_b, cosine, of the pairs with a term in common."""
    a = weights.select(F.col("column").alias("col_a"), "term", F.col("weight").alias("wa"))
    b = weights.select(F.col("column").alias("col_b"), "term", F.col("weight").alias("wb"))
    return a.join(b, "term").filter("col_a < col_b").groupBy("col_a", "col_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


# Tokens that speak for a type of entity, in the order of the types when scores are equal.
TYPE_SIGNALS = (
    ("person", ("name", "email", "phone", "address", "contact", "first", "last")),
    ("transaction", ("amount", "total", "price", "cost", "fee", "tax", "discount")),
    ("document", ("invoice", "receipt", "statement", "report", "doc", "contract")),
    ("product", ("product", "item", "sku", "upc", "barcode", "material")),
    ("reference", ("status", "type", "category", "code", "flag", "indicator")),
)


def entity_types(groups: DataFrame) -> DataFrame:
    """entity, entity_type, score: the type with most signal tokens among the columns' distinct tokens. Of (entity, column)."""
    spark = groups.sparkSession
    signals = spark.createDataFrame([(i, t, w) for i, (t, ws) in enumerate(TYPE_SIGNALS) for w in ws], "priority int, entity_type string, token string")
    own = groups.select("entity", F.explode(name_tokens(F.col("column"))).alias("token")).distinct()
    score = own.join(F.broadcast(signals), "token").groupBy("entity", "priority", "entity_type").agg(F.count("*").alias("score"))
    best = score.groupBy("entity").agg(F.max_by(F.struct("entity_type", "score"), F.struct("score", -F.col("priority"))).alias("b"))
    return groups.select("entity").distinct().join(best, "entity", "left").select(
        "entity", F.coalesce("b.entity_type", F.lit("business_object")).alias("entity_type"), F.coalesce("b.score", F.lit(0)).cast("long").alias("score")
    )
