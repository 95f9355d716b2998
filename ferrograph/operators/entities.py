"""Entities: groups of columns, by clustering their features and refining by names and values.

Features and similarities come from distributed operators; what is clustered is one row per column.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.config import EngineConfig
from ferrograph.errors import DataError
from ferrograph.operators import keys, names, profile

# Prefixes that name nothing, and words passed over when a name is sought elsewhere.
GENERIC = ("id", "val", "num", "col", "field", "data")
PASSED_OVER = ("id", "val", "no", "key")
TYPE_CODE = {t: float(i) for i, t in enumerate(profile.TYPES)}


def feature_rows(df: DataFrame, order: list[str], config: EngineConfig | None = None) -> DataFrame:
    """The column profile with the fifteen features of each column as an array."""
    p = profile.column_profile(df, order, config)
    code = F.create_map(*(F.lit(v) for t, c in TYPE_CODE.items() for v in (t, c)))[F.col("semantic_type")]
    number = F.col("semantic_type") == "numeric"
    zero = F.lit(0.0)
    cell = lambda c: F.coalesce(F.col(c).cast("double"), zero)
    parts = [
        F.coalesce(code, F.lit(6.0)), cell("missing_rate"), cell("unique_ratio"),
        *(F.when(number, cell(c)).otherwise(zero) for c in ("norm_mean", "cv", "min", "max")),
        cell("avg_tokens"), (F.col("semantic_type") == "id").cast("double"), (F.col("semantic_type") == "datetime").cast("double"),
        cell("entropy"), cell("top1"), cell("top2"), cell("top3"), cell("n_distinct"),
    ]
    return p.withColumn("features", F.array(*parts))


def feature_matrix(df: DataFrame, order: list[str], config: EngineConfig | None = None) -> tuple[list[str], np.ndarray, dict[str, str]]:
    """Columns in the table's order, their scaled features with name dimensions, and their types."""
    c = config or EngineConfig()
    rows = {r["column"]: r for r in feature_rows(df, order, c).collect()}
    columns = [x for x in df.columns if x in rows]
    x = np.nan_to_num(np.array([rows[k]["features"] for k in columns], float), nan=0.0, posinf=1.0, neginf=-1.0)
    dev = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(dev > 0, dev, 1)
    spark = df.sparkSession
    weights = names.tfidf(spark.createDataFrame([(k,) for k in columns], "column string"), c.features.tfidf_features).collect()
    term = {t: i for i, t in enumerate(sorted({r["term"] for r in weights}))}
    t = np.zeros((len(columns), len(term)))
    at = {k: i for i, k in enumerate(columns)}
    for r in weights:
        t[at[r["column"]], term[r["term"]]] = r["weight"]
    if t.shape[1] > c.features.name_dims:  # principal components
        t = t - t.mean(axis=0)
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = (u * s)[:, : c.features.name_dims]
    return columns, np.hstack([x, t]), {k: rows[k]["semantic_type"] for k in columns}


def ward(x: np.ndarray, distance: float) -> list[int]:
    """Agglomerative clusters by Ward's criterion, merged while the linkage is below `distance`.

    Squared linkages are updated by Lance and Williams' recurrence.
    """
    n = len(x)
    if n < 2:
        raise DataError("clustering needs two columns at least", columns=n)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    member = [[i] for i in range(n)]
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        i, j = divmod(int(d.argmin()), n)
        if np.sqrt(d[i, j]) >= distance:
            break
        i, j = min(i, j), max(i, j)
        rest = alive.copy()
        rest[[i, j]] = False
        k = np.flatnonzero(rest)
        new = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / (size[i] + size[j] + size[k])
        d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        member[i] += member[j]
        alive[j] = False
    label = [0] * n
    for c, i in enumerate(np.flatnonzero(alive)):
        for m in member[i]:
            label[m] = c
    return label


def tokenise(column: str) -> list[str]:
    import re

    return [t.lower() for t in re.split(r"[_\-\s]+|(?<=[a-z])(?=[A-Z])", column) if t]


def merge_by_names(groups: list[list[str]], cosine: dict[tuple, float], least: float) -> list[list[str]]:
    """Groups whose columns' names are alike on average go together (averages are those of the groups as given)."""
    root = list(range(len(groups)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(groups)):
        for j in range(i + 1, len(groups)):
            values = [cosine.get((min(a, b), max(a, b)), 0.0) for a in groups[i] for b in groups[j]]
            if sum(values) / len(values) >= least:
                root[find(j)] = find(i)
    out: dict[int, list[str]] = {}
    for i, g in enumerate(groups):
        out.setdefault(find(i), []).extend(g)
    return list(out.values())


def split_by_values(groups: list[list[str]], types: dict[str, str], jaccard: dict[tuple, float], least: float = 0.05) -> list[list[str]]:
    """A group with two identifier or category columns of different first words that share hardly a value is split by first word."""
    out = []
    for g in groups:
        keyed = [c for c in g if types[c] in ("id", "categorical")]
        apart = any(
            jaccard.get((min(a, b), max(a, b)), 0.0) < least and tokenise(a)[:1] != tokenise(b)[:1]
            for i, a in enumerate(keyed)
            for b in keyed[i + 1 :]
        )
        if apart:
            parts: dict[str, list[str]] = {}
            for c in g:
                parts.setdefault((tokenise(c) or [""])[0], []).append(c)
            out += parts.values()
        else:
            out.append(g)
    return out


def absorb_small(groups: list[list[str]], x: dict[str, np.ndarray], least: int) -> list[list[str]]:
    """Groups below the least size go to the nearest centre among the others."""
    big = [list(g) for g in groups if len(g) >= least]
    if not big:
        return groups
    centre = [np.mean([x[c] for c in g], axis=0) for g in big]
    for g in groups:
        if len(g) < least:
            own = np.mean([x[c] for c in g], axis=0)
            big[int(np.argmin([np.linalg.norm(own - c) for c in centre]))] += g
    return big


def entity_name(columns: list[str]) -> str:
    first = [tokenise(c)[0] for c in columns if tokenise(c)]
    prefix = Counter(first).most_common(1)[0][0] if first else ""
    if prefix and prefix not in GENERIC:
        return prefix.title()
    for c in sorted(columns, key=len):
        telling = [t for t in tokenise(c) if t not in PASSED_OVER]
        if telling:
            return telling[0].title()
    return "Entity"


def entity_type(columns: list[str]) -> str:
    words = {t for c in columns for t in tokenise(c)}
    best = max(names.TYPE_SIGNALS, key=lambda s: len(words & set(s[1])))  # the first of equal ones
    return best[0] if words & set(best[1]) else "business_object"


def representative(columns: list[str], types: dict[str, str]) -> str:
    ids = sorted(c for c in columns if types[c] == "id")
    return ids[0] if ids else next((c for c in columns if c.lower().endswith("_id")), columns[0])


def discover(df: DataFrame, order: list[str], config: EngineConfig | None = None) -> tuple[list[dict], dict[str, str]]:
    """Entities (name, type, columns, confidence, representative, description, cluster), most columns first, and the columns' types."""
    config = config or EngineConfig()
    columns, x, types = feature_matrix(df, order, config)
    labels = ward(x, config.ward_distance)
    groups = [[c for c, g in zip(columns, labels) if g == k] for k in range(max(labels) + 1)]
    spark = df.sparkSession
    cosine = {
        (r["col_a"], r["col_b"]): r["cosine"]
        for r in names.cosines(names.tfidf(spark.createDataFrame([(c,) for c in columns], "column string"), config.features.tfidf_features)).collect()
    }
    groups = merge_by_names(groups, cosine, config.name_merge)
    keyed = [c for c in columns if types[c] in ("id", "categorical", "boolean")]
    jaccard = {}
    if len(keyed) > 1:
        sets = keys.value_sets(df, keyed, config.features.overlap_sample, config.seed)
        jaccard = {(r["col_a"], r["col_b"]): r["jaccard"] for r in keys.jaccard_overlap(sets).collect()}
    groups = split_by_values(groups, types, jaccard)
    groups = absorb_small(groups, dict(zip(columns, x)), config.min_cluster)
    out, used = [], Counter()
    for i, g in enumerate(sorted(groups, key=len, reverse=True)):
        g = sorted(g, key=columns.index)
        name = entity_name(g)
        used[name] += 1
        if used[name] > 1:
            name = f"{name} {used[name]}"
        pairs = [cosine.get((min(a, b), max(a, b)), 0.0) for k, a in enumerate(g) for b in g[k + 1 :]]
        kind = entity_type(g)
        out.append(
            {
                "name": name, "type": kind, "columns": g, "confidence": round(float(np.mean(pairs)) if pairs else 1.0, 3), "cluster_id": i,
                "representative": representative(g, types), "description": f"{name}: a {kind} with {len(g)} columns, among them {', '.join(g[:3])}",
            }
        )
    return out, types
