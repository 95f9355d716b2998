"""Secret scanning with corpus-wide ownership frequency, in DataFrame operations only.

Pattern matches give the base spans. Opaque tokens of 24 characters and more (mixed case and digits) are further
candidates. Hashes of all candidate values are counted over the corpus by distinct repositories
(documents, by doc_id) and distinct owners: a value that several owners have, or that many repositories have, is a widely
copied example; one of a single owner and few repositories looks live. Live opaque tokens are added to the spans.

Offsets are code points, end exclusive. A null text counts as empty; a null owner is an owner of its own.
Rows are independent: a repeated doc_id gives a row each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrograph.llm.shared import met, saved

# The kinds in their order, and their patterns (Java regular expressions).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "opaque")
BLOCK = 256


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of all matches, leftmost and not overlapping.

    Starts follow from the lengths of the matches and of what `split` leaves between them; the
    sums are taken by blocks, so that many matches in a text don't cost the square of their number.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.struct(hits.alias("m"), gaps.alias("g"))
    steps = F.transform(both["m"], lambda m, i: F.length(m) + F.get(both["g"], i))

    def build(x: Column) -> Column:
        m, s = x["m"], x["s"]

        def one(v: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            end = _sum(F.slice(x["b"], F.lit(1), block)) + _sum(F.slice(s, block * BLOCK + 1, i % BLOCK + 1))
            return F.struct((end - F.length(v)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), v.alias("value"))

        return F.transform(m, one)

    def with_blocks(x: Column) -> Column:
        s = x["s"]
        b = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(s) / BLOCK).cast("int")),
            lambda k: _sum(F.slice(s, k * BLOCK + 1, F.lit(BLOCK))),
        )
        return F.struct(x["m"].alias("m"), s.alias("s"), b.alias("b"))

    one_row = F.array(F.struct(hits.alias("m"), steps.alias("s")))
    out = F.flatten(F.transform(F.transform(one_row, with_blocks), build))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """key, doc_id, owner, base and extra: arrays of spans with the hash of the value."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).alias("owner"), text.alias("text"))
    rows = rows.select("doc_id", "owner", *(_spans(F.col("text"), p, k).alias(KINDS[k]) for k, p in enumerate((ASSIGN, ACCESS, HEX, OPAQUE))))
    assign = F.filter(
        F.transform("assign", lambda s: s.withField("value", F.regexp_extract(s["value"], ASSIGN, 2))),
        lambda s: F.length(s["value"]) >= 8,
    )
    rows = rows.select("doc_id", "owner", F.array_sort(F.concat(assign, "access", "hex")).alias("base"), "opaque")
    extra = F.filter(
        "opaque",
        lambda s: s["value"].rlike("[0-9]")
        & s["value"].rlike("[a-z]")
        & s["value"].rlike("[A-Z]")
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    hashed = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash"))
    )
    rows = rows.select("doc_id", "owner", hashed(F.col("base")).alias("base"), hashed(extra).alias("extra"))
    return rows.withColumn("key", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: in how many documents and by how many owners a value is found."""
    values = found.select("owner", "doc_id", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: s["hash"]))).alias("hash"))
    # a document and its owner first, so that no value's documents meet in one task
    by_document = values.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = by_document.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, owner: str = "source", example_owners: int = 3, example_repositories: int = 20) -> DataFrame:
    """One row per row of `docs` (doc_id, text and the owner's column).

    n_example: candidates that at least `example_owners` owners or `example_repositories` repositories have; n_live:
    those of a single owner that are no examples.
    """
    found = saved(candidates(docs, owner), "found")
    cells = found.select("key", F.explode(F.concat("base", "extra")).alias("s")).select("key", "s.*")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    live = (F.col("owners") == 1) & ~example
    rated = (
        met(cells, saved(ownership(found), "owned"), "hash", "repositories")
        .groupBy("key")
        .agg(
            F.count_if(live).alias("n_live"),
            F.count_if(example).alias("n_example"),
            F.max("owners").alias("max_owners"),
            F.max("repositories").alias("max_repositories"),
            F.collect_list(F.when((F.col("kind") == 3) & live, F.struct("start", "kind", "end"))).alias("live"),
        )
    )
    out = found.join(rated, "key", "left")
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    base, live = bare(F.col("base")), F.coalesce("live", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_text(base), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat(base, live))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("max_owners", F.lit(0)).cast("long").alias("max_owners"),
        F.coalesce("max_repositories", F.lit(0)).cast("long").alias("max_repositories"),
    )
