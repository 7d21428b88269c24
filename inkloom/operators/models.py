"""Feature reduction, edge splits and comparisons of clusterings (survey M7, M8, M10's offline part, M19, M21, M23, H15, H16, P23, R5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .vectors import unit

#: Feature views kept by each variant.
VARIANTS = {
    "full": ("vs_emb", "sents_graph_emb", "summarized_emb", "event_emb"),
    "no_graph": ("vs_emb", "summarized_emb", "event_emb"),
    "no_summary": ("vs_emb", "sents_graph_emb", "event_emb"),
    "no_event": ("vs_emb", "sents_graph_emb", "summarized_emb"),
    "semantic": ("vs_emb",),
}


def widths(df: DataFrame, views: Sequence[str]) -> dict[str, int]:
    """Width of each view from its most frequent length, 0 where it has none."""
    out = {}
    for v in views:
        top = df.where(F.size(v) > 0).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        out[v] = top[0].n if top else 0
    return out


def fused(df: DataFrame, key: str, views: Sequence[str]) -> DataFrame:
    """(``key``, features): unit views side by side, zeros for a missing one (M8; the
    offline stand-in for the learned fusion, M10)."""
    size = widths(df, views)
    parts = [F.when(F.size(v) == n, unit(F.col(v))).otherwise(F.array_repeat(F.lit(0.0), n)) for v, n in size.items() if n]
    return df.select(key, (F.concat(*parts) if parts else F.array().cast("array<double>")).alias("features"))


def reduced(df: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """(``key``, reduced): main axes of the features, unit length."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(features)))
    n = df.select(F.size(features).alias("n")).agg(F.max("n")).first()[0]
    if not n:
        return df.select(key, F.col(features).alias("reduced"))
    m = PCA(k=min(k, n), inputCol="_v", outputCol="_r").fit(v)
    return m.transform(v).select(key, unit(vector_to_array("_r")).alias("reduced"))


def edge_split(edges: DataFrame, test: float = 0.10, valid: float = 0.05, seed: int = 1) -> DataFrame:
    """``edges`` (a, b) with part: train, valid or test by hash, the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(10**6)) / 10**6
    return edges.withColumn("part", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))


def negative_edges(edges: DataFrame, seed: int = 1) -> DataFrame:
    """As many pairs that are no edges, at most: each edge's head gets the tail of the
    next edge in a hashed order, taken within blocks of that order (M19)."""
    h = F.xxhash64(F.lit(seed), "a", "b")
    w = Window.partitionBy(F.pmod(F.shiftright(h, 8), F.lit(64))).orderBy(h)
    pairs = edges.select("a", F.lead("b").over(w).alias("c")).where("c is not null and a <> c")
    pairs = pairs.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    return pairs.join(edges, ["a", "b"], "left_anti")


def compare(df: DataFrame, key: str, features: str, label: str, k: int, seeds: Sequence[int] = range(3)) -> DataFrame:
    """(method, seed, ari, nmi, b3_f1) of k-means, Gaussian mixture and bisecting
    k-means against the labels (M21)."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.functions import array_to_vector

    from .stats import contingency, external_measures

    v = df.withColumn("_v", array_to_vector(F.col(features)))
    out = None
    for seed in seeds:
        for name, model in (("kmeans", KMeans), ("gmm", GaussianMixture), ("bisecting", BisectingKMeans)):
            c = model(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(v).transform(v)
            row = external_measures(contingency(c, label, "_c")).select(F.lit(name).alias("method"), F.lit(seed).alias("seed"), "ari", "nmi", "b3_f1")
            out = row if out is None else out.unionByName(row)
    return out


def best_run(runs: DataFrame, setting: str, metric: str, value: str) -> DataFrame:
    """(metric, setting, value): best run of a grid for each metric."""
    return runs.groupBy(metric).agg(F.max_by(setting, value).alias(setting), F.max(value).alias(value))
