"""Vector features: scaling, projection, dimension choice, taxonomy closeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.operators.projection import fit_components


def as_vector(df: DataFrame, vec: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(vec).cast("array<double>")))


def standard_scale(df: DataFrame, vec: str, name: str | None = None) -> DataFrame:
    """Zero mean and unit population deviation per dimension; constant dimensions stay at 0 (K9)."""
    x = array_to_vector(F.col(vec).cast("array<double>"))
    stats = df.agg(Summarizer.metrics("mean", "variance", "count").summary(x).alias("s"))
    n = F.col("s.count")
    deviation = F.transform(
        vector_to_array("s.variance"), lambda var: F.sqrt(var * (n - 1) / n)
    )
    # one scalar subquery with both vectors
    steps = F.transform(deviation, lambda d: F.when(d > 0, d).otherwise(1.0))
    scale = stats.select(F.arrays_zip(vector_to_array("s.mean").alias("mean"), steps.alias("step")).alias("z")).scalar()
    ready = df.withColumn("_scale", scale)
    scaled = F.zip_with(F.col(vec).cast("array<double>"), F.col("_scale"), lambda a, z: (a - z["mean"]) / z["step"])
    return ready.withColumn(name or vec, scaled).drop("_scale")


def pca(df: DataFrame, vec: str, name: str = "projected", k: int | None = None, variance: float | None = None) -> DataFrame:
    """Centred coordinates along ``k`` components, or along the fewest that explain a share of the variance (K8)."""
    return df.withColumn(name, fit_components(df, vec, k, variance).apply(vec))


def anova_f(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(dim, f): one-way ANOVA F value of every dimension, from per-class means and variances.

    The class summaries (one row per class) are exploded, not the rows.
    """
    x = array_to_vector(F.col(vec).cast("array<double>"))
    per_class = df.groupBy(label).agg(Summarizer.metrics("mean", "variance", "count").summary(x).alias("s"))
    wide = per_class.select(
        F.col("s.count").alias("n"),
        F.posexplode(F.arrays_zip(vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))).alias("dim", "z"),
    ).select("n", "dim", F.col("z.m").alias("m"), F.col("z.v").alias("v"))
    sums = wide.groupBy("dim").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
    )
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")
    f = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("total") - F.col("k")))
    return sums.select("dim", f.alias("f"))


def select_dims(df: DataFrame, vec: str, label: str, k: int, test: str = "anova", name: str = "selected") -> DataFrame:
    """Best ``k`` dimensions by ANOVA F (continuous) or chi-square (categorical values)."""
    ready = as_vector(df, vec, "_x").withColumn("_label", F.col(label).cast("double"))
    kind = "continuous" if test == "anova" else "categorical"
    selector = UnivariateFeatureSelector(
        featuresCol="_x", labelCol="_label", outputCol="_y", selectionMode="numTopFeatures"
    )
    selector.setFeatureType(kind).setLabelType("categorical").setSelectionThreshold(k)
    out = selector.fit(ready).transform(ready)
    return out.withColumn(name, vector_to_array("_y")).drop("_x", "_y", "_label")


def taxonomy_edges(df: DataFrame, leaf: str, group: str, root: str = "root") -> DataFrame:
    """(child, parent) edges of a root-group-leaf tree; leaves without a group are left out."""
    known = df.where(F.col(group).isNotNull())
    low = known.select(F.col(leaf).alias("child"), F.col(group).alias("parent"))
    high = known.select(F.col(group).alias("child"), F.lit(root).alias("parent"))
    return low.union(high).distinct()


def closeness(df: DataFrame, leaf: str, group: str, root: str = "root") -> DataFrame:
    """(node, kind, closeness) for every node of a root-group-leaf tree.

    All distances in such a tree follow from the group sizes, so path sums come from two counts
    instead of a search between all pairs of nodes. The tree is connected, so the value is
    ``(nodes - 1) / sum of distances``.
    """
    leaves = df.where(F.col(group).isNotNull()).select(F.col(leaf).alias("leaf"), F.col(group).alias("grp")).distinct()
    sizes = leaves.groupBy("grp").agg(F.count("*").alias("m"))
    all_leaves = sizes.agg(F.sum("m")).scalar()
    all_groups = sizes.agg(F.count("*")).scalar()
    counted = sizes.withColumns({"l": all_leaves, "g": all_groups})
    low = leaves.join(counted, "grp").select(
        F.col("leaf").alias("node"), F.lit("leaf").alias("kind"), _leaf_closeness(F.col("m"), F.col("l"), F.col("g"))
    )
    m, total, g = F.col("m"), F.col("l"), F.col("g")
    mid = counted.select(
        F.col("grp").alias("node"),
        F.lit("group").alias("kind"),
        ((total + g) / (1 + m + 2 * (g - 1) + 3 * (total - m))).alias("closeness"),
    )
    top = sizes.agg(F.sum("m").alias("l"), F.count("*").alias("g")).select(
        F.lit(root).alias("node"), F.lit("root").alias("kind"), ((F.col("l") + F.col("g")) / (F.col("g") + 2 * F.col("l"))).alias("closeness")
    )
    return low.union(mid).union(top)


def _leaf_closeness(m, leaves, groups):
    """From a leaf: its group 1, the root 2, siblings 2, other groups 3, other leaves 4."""
    paths = 1 + 2 + 2 * (m - 1) + 3 * (groups - 1) + 4 * (leaves - m)
    return ((leaves + groups) / paths).alias("closeness")


def closeness_when_added(known: DataFrame, candidates: DataFrame, leaf: str, group: str) -> DataFrame:
    """Closeness of each candidate leaf after adding it alone to the tree of known leaves."""
    base = known.where(F.col(group).isNotNull()).select(leaf, group).distinct()
    sizes = base.groupBy(group).agg(F.count("*").alias("m"))
    totals = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("l"), F.count("*").alias("g"))
    fresh = candidates.where(F.col(group).isNotNull()).select(leaf, group).distinct()
    marked = fresh.join(sizes, group, "left").join(
        base.select(leaf, F.lit(1).alias("_in")), leaf, "left"
    )
    grown = marked.select(
        leaf,
        F.coalesce("m", F.lit(0)).alias("m0"),
        F.when(F.col("_in").isNull(), 1).otherwise(0).alias("new_leaf"),
        F.when(F.col("m").isNull(), 1).otherwise(0).alias("new_group"),
    )
    leaves, groups = totals.select("l").scalar(), totals.select("g").scalar()
    return grown.select(
        F.col(leaf).alias("node"),
        _leaf_closeness(F.col("m0") + F.col("new_leaf"), leaves + F.col("new_leaf"), groups + F.col("new_group")),
    )


def stack_scores(tables: Sequence[tuple[DataFrame, str]], keys: Sequence[str], name: str = "stacked") -> DataFrame:
    """Score vectors of several models side by side, joined on their keys."""
    first, col = tables[0]
    out = first.select(*keys, F.col(col).cast("array<double>").alias("_s0"))
    for i, (df, col) in enumerate(tables[1:], 1):
        out = out.join(df.select(*keys, F.col(col).cast("array<double>").alias(f"_s{i}")), list(keys))
    return out.select(*keys, F.concat(*[f"_s{i}" for i in range(len(tables))]).alias(name))
