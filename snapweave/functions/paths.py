"""Path expressions and path aggregates. Prefixes and order go by components, not by characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def under(path: Column, root: Column) -> Column:
    """Whether ``path`` is ``root`` or below it; the empty root holds every path."""
    return (path == root) | path.startswith(F.concat(F.when(root == "/", "").otherwise(root), F.lit("/"))) | (root == "")


def path_included(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Exclusion wins; included is what lies under an include or above one. No include list: everything."""
    ok = F.lit(True)
    for x in exclude or []:
        ok = ok & ~under(path, F.lit(x))
    if include is not None:
        some = F.lit(False)
        for x in include:
            some = some | under(path, F.lit(x)) | under(F.lit(x), path)
        ok = ok & some
    return ok


def filter_paths(df: DataFrame, path_col: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose path is included. Null paths are left out."""
    return df.where(F.col(f"`{path_col}`").isNotNull() & path_included(F.col(f"`{path_col}`"), include, exclude))


def parent_of(path: Column) -> Column:
    """The path above; null for the root and for a single name."""
    return F.when(path.rlike("^/[^/]+$"), "/").when(path.contains("/") & (path != "/"), F.regexp_replace(path, "/[^/]*$", ""))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_order(path: Column) -> Column:
    """Sort key: components compared one by one, so a/b comes before a.b."""
    return F.split(path, "/")


def strip_prefix(path: Column, prefix: str) -> Column:
    """The path below ``prefix``; null for paths not under it and for the prefix itself."""
    return F.when(path.startswith(prefix + "/"), F.substring(path, len(prefix) + 2, 1 << 30))


def ancestors(path: Column) -> Column:
    """All proper ancestors of an absolute path, the nearest to the root first, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def children_counts(df: DataFrame, path_col: str) -> DataFrame:
    """(parent, n_children): distinct direct children of every directory above a path, the root as '/'."""
    p = F.col(f"`{path_col}`")
    step = F.explode(F.concat(ancestors(p), F.array(p))).alias("child")
    links = df.where(p.isNotNull()).select(step).distinct()
    return links.groupBy(parent_of(F.col("child")).alias("parent")).agg(F.count(F.lit(1)).alias("n_children"))


def common_prefix(df: DataFrame, path_col: str, by: str | None = None, strict: bool = False) -> DataFrame:
    """Longest common path of each group (column ``lcp``). A group with one distinct path gives its parent unless ``strict``.

    Per group and depth the least and greatest prefix of that depth are compared: a two-column aggregate with partial
    sums, however large a group is.
    """
    p = F.col(f"`{path_col}`")
    g = F.col(f"`{by}`") if by else F.lit(0)
    least = df.where(p.isNotNull()).groupBy(g.alias("g")).agg(F.min(F.split(p, "/")).alias("a"), F.max(F.split(p, "/")).alias("b"))
    pairs = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.coalesce(F.nullif(F.array_position(pairs, False), F.lit(0)) - 1, F.size(pairs).cast("long")).cast("int")
    shared = F.slice("a", 1, F.greatest(n, F.lit(0)))
    one = F.col("a") == F.col("b")
    shared = shared if strict else F.when(one, F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(0)))).otherwise(shared)
    out = least.select("g", F.array_join(shared, "/").alias("lcp"))
    return out.withColumnRenamed("g", by) if by else out.select("lcp")


def resolve(nodes: DataFrame, path_col: str, wanted: list[str]) -> DataFrame:
    """The nodes at the wanted paths: an equality on the stored path, one lookup whatever the depth."""
    return nodes.where(F.col(f"`{path_col}`").isin([w.rstrip("/") for w in wanted if w]))

