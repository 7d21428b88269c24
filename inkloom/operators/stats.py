"""Score tables, tests and cluster measures (survey A10-A14, A16, A19-A24, A32, M22, M24, M25, W10, K9, P14, J12, A15)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def valid_scores(df: DataFrame, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """Successful rows with a score in range; a missing status is success."""
    return df.where((F.coalesce(F.col("status"), F.lit("success")) == "success") & F.col("score").between(low, high))


def means(df: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """Mean, sample deviation (0 for one row) and count."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def group_means(df: DataFrame, method: str, metric: str, group: Column, value: str) -> DataFrame:
    """(method, grp, mean): the mean of metric means per group, and over all groups
    under 'overall' (A19)."""
    per = df.groupBy(method, metric).agg(F.avg(value).alias("m"))
    grp = per.withColumn("grp", group).groupBy(method, "grp").agg(F.avg("m").alias("mean"))
    return grp.unionByName(grp.groupBy(method).agg(F.avg("mean").alias("mean")).withColumn("grp", F.lit("overall")))


def common(df: DataFrame, key: str, method: str, n: int) -> DataFrame:
    """Rows whose key occurs with all ``n`` methods."""
    full = df.groupBy(key).agg(F.count_distinct(method).alias("_n")).where(F.col("_n") == n).select(key)
    return df.join(full, key, "left_semi")


def paired_difference(df: DataFrame, key: str, method: str, value: str) -> DataFrame:
    """(a, b, n, mean_diff) for each pair of methods over common keys."""
    one = df.groupBy(key, method).agg(F.avg(value).alias("v"))
    a, b = one.select(key, F.col(method).alias("a"), F.col("v").alias("va")), one.select(key, F.col(method).alias("b"), F.col("v").alias("vb"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.col("va") - F.col("vb")).alias("mean_diff"))


def best_and_second(df: DataFrame, column: str, value: str, digits: int = 12) -> DataFrame:
    """``df`` with mark: best or second of each column's distinct values."""
    w = Window.partitionBy(column).orderBy(F.desc(F.round(value, digits)))
    r = F.dense_rank().over(w)
    return df.withColumn("mark", F.when(r == 1, "best").when(r == 2, "second"))


def category_stats(df: DataFrame, book: str, category: str, seq: str) -> DataFrame:
    """(category, books, mean_at, median_at, p90_at, mean_n) over books: where a category
    stands in a book on average, as a share of its length, and how often (A15)."""
    longest = df.groupBy(book).agg(F.max(seq).alias("_max"))
    per = df.join(longest, book).groupBy(book, category).agg(F.avg(F.col(seq) / F.col("_max")).alias("at"), F.count("*").alias("n"))
    return per.groupBy(category).agg(F.count("*").alias("books"), F.avg("at").alias("mean_at"), F.percentile("at", F.lit(0.5)).alias("median_at"), F.percentile("at", F.lit(0.9)).alias("p90_at"), F.avg("n").alias("mean_n"))


def balance(df: DataFrame) -> DataFrame:
    """Of (k, silhouette, dbi, small_ratio): quality, support and their harmonic mean."""
    per = df.groupBy("k").agg(F.avg("silhouette").alias("sil"), F.avg("dbi").alias("dbi"), F.avg("small_ratio").alias("small"))
    w = Window.partitionBy()
    q = 50 * (F.col("sil") / F.max("sil").over(w) + F.min("dbi").over(w) / F.col("dbi"))
    r = per.select("k", q.alias("quality"), (100 * (1 - F.col("small"))).alias("support"))
    both = F.col("quality") + F.col("support")
    return r.withColumn("balance", F.when(both == 0, 0.0).otherwise(2 * F.col("quality") * F.col("support") / both))


def contingency(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """(label, cluster, n) (A10)."""
    return df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def external_measures(table: DataFrame) -> DataFrame:
    """One row (ari, nmi, b3_p, b3_r, b3_f1), x 100, out of a contingency table."""
    w = Window.partitionBy
    t = table.withColumn("a", F.sum("n").over(w("label"))).withColumn("b", F.sum("n").over(w("cluster"))).withColumn("t", F.sum("n").over(w()))
    pairs = lambda c: c * (c - 1) / 2.0
    n, a, b, total = (F.col(c).cast("double") for c in ("n", "a", "b", "t"))
    # a label's pairs appear once per cell, so each cell takes its share
    s = t.agg(
        F.sum(pairs(n)).alias("s"), F.sum(pairs(a) * n / a).alias("sa"), F.sum(pairs(b) * n / b).alias("sb"), F.max(pairs(total)).alias("st"),
        F.sum(n / total * F.log(n * total / (a * b))).alias("mi"), F.sum(-n / total * F.log(a / total)).alias("ha"), F.sum(-n / total * F.log(b / total)).alias("hb"),
        F.sum(n * n / b / total).alias("p"), F.sum(n * n / a / total).alias("r"),
    )
    expected = F.col("sa") * F.col("sb") / F.col("st")
    ari = F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0))
    nmi = F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0))
    f1 = F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return s.select((100 * ari).alias("ari"), (100 * nmi).alias("nmi"), (100 * F.col("p")).alias("b3_p"), (100 * F.col("r")).alias("b3_r"), (100 * f1).alias("b3_f1"))


def majority_labels(table: DataFrame) -> DataFrame:
    """(cluster, label, n): each cluster's most frequent label."""
    return table.groupBy("cluster").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"), F.max("n").alias("n"))


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest assignment (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row, delta, nxt = match[j], np.inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    d = cost[row - 1, k - 1] - u[row] - v[k]
                    if d < least[k]:
                        least[k], way[k] = d, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = [-1] * n
    for k in range(1, m + 1):
        if match[k]:
            out[match[k] - 1] = k - 1
    return out


def accuracy(table: DataFrame, most_classes: int = 4096) -> float:
    """Share of rows in the best one-to-one matching (A12).  The table has labels x
    clusters cells; more than ``most_classes`` of either is refused, not cut."""
    cells = table.limit(most_classes * most_classes + 1).toPandas()
    labels, clusters = cells["label"].unique(), cells["cluster"].unique()
    if max(len(labels), len(clusters)) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    size = max(len(labels), len(clusters))
    m = np.zeros((size, size))
    row, col = {x: i for i, x in enumerate(labels)}, {x: i for i, x in enumerate(clusters)}
    for a, b, n in zip(cells["label"], cells["cluster"], cells["n"]):
        m[row[a], col[b]] += n
    return 100.0 * sum(m[i, j] for i, j in enumerate(hungarian(m.max() - m))) / m.sum() if m.sum() else 0.0


def cluster_sizes(df: DataFrame, cluster: str, small: int = 5) -> DataFrame:
    """(cluster, n, is_small)."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n")).withColumn("is_small", F.col("n") < small)


def wilcoxon(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(statistic, two-sided p): signed ranks, zeros dropped, normal approximation
    with tie and continuity correction (M24)."""
    from math import erfc, sqrt

    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    rank = pd.Series(np.abs(d)).rank().to_numpy()
    plus, minus = rank[d > 0].sum(), rank[d < 0].sum()
    stat = min(plus, minus)
    ties = pd.Series(np.abs(d)).value_counts().to_numpy()
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    z = (abs(stat - n * (n + 1) / 4) - 0.5) / sqrt(var) if var > 0 else 0.0
    return float(stat), float(min(1.0, erfc(max(z, 0.0) / sqrt(2))))


def paired_bootstrap(diff: np.ndarray, resamples: int = 10000, level: float = 0.95, seed: int = 1, block: int = 1000) -> tuple[float, float]:
    """Interval of the mean difference (M25), resampled in blocks."""
    rng = np.random.default_rng(seed)
    got = np.concatenate([diff[rng.integers(0, len(diff), (min(block, resamples - i), len(diff)))].mean(1) for i in range(0, resamples, block)])
    low, high = np.quantile(got, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def signed_ranks(pairs: DataFrame, keys: Sequence[str], diff: str) -> DataFrame:
    """(keys, n, w, z) of paired differences: the lesser sum of signed ranks, zeros
    dropped, ranks of ties averaged, and its normal score with tie and continuity
    correction (M24).  Equal differences are counted before they are ranked."""
    size = F.round(F.abs(diff), 12)
    counted = pairs.where(F.round(diff, 12) != 0).groupBy(*keys, size.alias("_d")).agg(F.count("*").alias("t"), F.count_if(F.col(diff) > 0).alias("up"))
    w = Window.partitionBy(*keys).orderBy("_d")
    rank = F.sum("t").over(w) - F.col("t") + (F.col("t") + 1) / 2
    s = counted.withColumn("_r", rank).groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("_r") * F.col("up")).alias("up"), F.sum(F.col("_r") * (F.col("t") - F.col("up"))).alias("down"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    low = F.least("up", "down")
    return s.select(*keys, "n", low.alias("w"), F.when(var > 0, F.greatest(F.lit(0.0), (F.abs(low - n * (n + 1) / 4) - 0.5) / F.sqrt(var))).otherwise(0.0).alias("z"))


def bootstrap_intervals(pairs: DataFrame, keys: Sequence[str], unit: str, diff: str, resamples: int = 10000) -> DataFrame:
    """(keys, low, high) of ``paired_bootstrap`` for each pair of methods (M25).  A pair's
    differences, one number a unit, meet in one task, as resampling them asks for."""
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = paired_bootstrap(pdf.sort_values(unit)[diff].to_numpy(), resamples)
        return pdf[list(keys)].iloc[:1].assign(low=low, high=high)

    return pairs.select(*keys, unit, diff).where(F.col(diff).isNotNull()).groupBy(*keys).applyInPandas(interval, f"{kinds}, low double, high double")


def two_sided(z: Column) -> Column:
    """Two-sided probability of a normal score; for the few rows of a table of tests."""
    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return s.map(lambda x: min(1.0, erfc(max(x, 0.0) / sqrt(2))))

    return p(z)


def silhouette(df: DataFrame, key: str, vector: str, cluster: str, most: int = 10000, block: int = 500) -> DataFrame:
    """(``key``, s) of at most ``most`` rows (those of least hash), exact among them
    (M22).  The sample, bounded by ``most``, goes to the tasks, each of which scores a
    share of it, ``block`` rows at a time."""
    import pyarrow as pa

    total = df.count()
    few = df.select(key, vector, cluster).where(F.col(vector).isNotNull())
    if total > 2 * most:  # only about twice as many rows as wanted are ordered
        few = few.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int((1 << 31) * (2.0 * most + 200) / total))
    small = few.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 31)), key).limit(most).toPandas()
    x = np.stack(small[vector].to_list()).astype(float) if len(small) else np.zeros((0, 1))
    x -= x.mean(0) if len(x) else 0
    c, known = pd.factorize(small[cluster], use_na_sentinel=False)
    member = np.eye(max(len(known), 1))[c]
    size, square = member.sum(0), (x * x).sum(1)
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((x, c, member, size, square))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, c, member, size, square = held.value
        for b in batches:
            at = b.column("_i").to_numpy()
            out = np.zeros(len(at))
            for k in range(0, len(at) if len(size) > 1 else 0, block):
                rows = at[k : k + block]
                d = np.sqrt(np.maximum(square[rows, None] + square - 2 * x[rows] @ x.T, 0))
                d[np.arange(len(rows)), rows] = 0
                sums, own = d @ member, c[rows]
                a = sums[np.arange(len(rows)), own] / np.maximum(size[own] - 1, 1)
                other = sums / size
                other[np.arange(len(rows)), own] = np.inf
                b_ = other.min(1)
                top = np.maximum(a, b_)
                out[k : k + block] = np.where((size[own] > 1) & (top > 0), np.divide(b_ - a, top, out=np.zeros(len(rows)), where=top > 0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out)], [key, "s"])

    kind = df.schema[key].dataType.simpleString()
    rows = spark.createDataFrame(pd.DataFrame({key: small[key], "_i": np.arange(len(small))}), f"{key} {kind}, _i long")
    return rows.repartition(min(64, max(1, len(small) // block))).mapInArrow(score, f"{key} {kind}, s double")
