"""Vectors, soft assignment and spherical clustering (survey A5, A8, A9, F26, M6, M7, M9, M11-M14, T3, T4, M22)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays (F26).  The length is bound once, not worked
    out again for each position."""
    return F.transform(F.array(length(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)


def long_form(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "value"))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(``key``, pos, value): mean per position (A5, A8, A9).  Whole vectors are summed
    in the tasks, those of one length together; only these sums are laid out by
    position, so a row costs no row per position and a hot key one sum per task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    full = df.where((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())).select(key, F.size(vector).alias("_n"), array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    sums = full.groupBy(key, "_n").agg(Summarizer.sum(F.col("_v")).alias("_s"), F.count("*").alias("_rows"))
    ragged = long_form(df.where(F.exists(vector, lambda x: x.isNull())), [key], vector).where("value is not null").select(key, "pos", F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("_rows"))
    laid = sums.select(key, F.posexplode(vector_to_array("_s")).alias("pos", "value"), "_rows").unionByName(ragged)
    return laid.groupBy(key, "pos").agg((F.sum("value") / F.sum("_rows")).alias("value"))


def as_arrays(means: DataFrame, key: str, name: str) -> DataFrame:
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(name))


def with_fallback(df: DataFrame, means: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with its mean vector, the mean of all where it has none."""
    overall = long_form(means, [key], name).groupBy("pos").agg(F.avg("value").alias("value")).groupBy(F.lit(1).alias("_1")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_all")).drop("_1")
    return df.join(means, key, "left").crossJoin(F.broadcast(overall)).withColumn(name, F.coalesce(name, "_all")).drop("_all")


def assign(df: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """(``key``, cluster, cos): nearest of few centres (cluster, centre) by cosine
    (M11).  The centres, whose number is a parameter of the model, are held in one
    array column, so each row is scored in place and nothing is shuffled."""
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", unit(F.col("centre")).alias("centre")))).alias("_c"))
    scored = df.crossJoin(F.broadcast(packed)).select(key, F.col(vector).alias("_v"), F.transform("_c", lambda c: F.struct(dot(F.col(vector), c["centre"]).alias("dot"), (-c["cluster"]).alias("back"))).alias("_s"))
    best = scored.select(key, "_v", F.array_max("_s").alias("b"))
    return best.select(key, (-F.col("b.back")).alias("cluster"), F.coalesce(F.try_divide(F.col("b.dot"), length(F.col("_v"))), F.lit(0.0)).alias("cos"))


def soft_arrays(df: DataFrame, key: str, vector: str, centres: DataFrame, normalise: bool = True) -> DataFrame:
    """(``key``, soft array<struct<cluster, p>>): Student-t shares over the distance to
    each of few centres (M11), in place: one row a row, no window.  Without
    ``normalise`` lengths count, as in the two-view baseline (M15)."""
    form = unit if normalise else lambda v: v
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", form(F.col("centre")).alias("centre")))).alias("_c"))
    near = df.select(key, form(F.col(vector)).alias("_v")).crossJoin(F.broadcast(packed))
    d2 = lambda c: F.aggregate(F.zip_with("_v", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    raw = near.select(key, F.transform("_c", lambda c: F.struct(c["cluster"].alias("cluster"), (1 / (1 + d2(c))).alias("w"))).alias("_w"))
    whole = raw.withColumn("_total", F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["w"]))
    return whole.select(key, F.transform("_w", lambda x: F.struct(x["cluster"].alias("cluster"), (x["w"] / F.col("_total")).alias("p"))).alias("soft"))


def target_arrays(soft: DataFrame, key: str) -> DataFrame:
    """``soft`` with q, squared shares over cluster mass, summing to 1 per row.
    The mass of each of the few clusters travels as one map."""
    mass = soft.select(F.explode("soft").alias("s")).groupBy("s.cluster").agg(F.sum("s.p").alias("f")).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "f"))).alias("_f"))
    w = soft.crossJoin(F.broadcast(mass)).select(key, F.transform("soft", lambda s: F.struct(s["cluster"].alias("cluster"), s["p"].alias("p"), (s["p"] * s["p"] / F.try_element_at("_f", s["cluster"])).alias("w"))).alias("_w"))
    whole = w.withColumn("_total", F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["w"]))
    return whole.select(key, F.transform("_w", lambda x: F.struct(x["cluster"].alias("cluster"), x["p"].alias("p"), (x["w"] / F.col("_total")).alias("q"))).alias("soft"))


def student_t(df: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """(``key``, cluster, p) of ``soft_arrays``."""
    return soft_arrays(df, key, vector, centres).select(key, F.inline("soft"))


def soft_target(df: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """(``key``, cluster, p, q) of ``target_arrays``."""
    return target_arrays(soft_arrays(df, key, vector, centres), key).select(key, F.inline("soft"))


def target(soft: DataFrame, key: str) -> DataFrame:
    """``soft`` (key, cluster, p) with q."""
    held = soft.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cluster", "p"))).alias("soft"))
    return target_arrays(held, key).select(key, F.inline("soft"))


def spherical_kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, runs: int = 1, weight: str | None = None) -> DataFrame:
    """(``key``, cluster): cosine k-means, the cheapest of ``runs``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_v", array_to_vector(unit(F.col(vector))))
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", distanceMeasure="cosine", predictionCol="cluster", **({"weightCol": weight} if weight else {})).fit(x) for i in range(runs)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).select(key, "cluster")


def _summed(df: DataFrame, vector: str, function) -> list:
    """Sum over all rows of the arrays that ``function`` makes of a block of unit
    vectors; partitions are added up in groups before the driver adds the rest."""
    import io

    import numpy as np
    import pyarrow as pa

    def pack(total) -> Iterator[pa.RecordBatch]:
        if total is not None:
            f = io.BytesIO()
            np.savez(f, *total)
            yield pa.RecordBatch.from_pydict({"b": pa.array([f.getvalue()], pa.binary())})

    def open_(data: bytes) -> list:
        with np.load(io.BytesIO(data)) as z:
            return [z[k] for k in z.files]

    def plus(total, more):
        return more if total is None else [a + b for a, b in zip(total, more)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float) if b.num_rows else np.zeros((0, 0))
            if len(x):
                n = np.linalg.norm(x, axis=1, keepdims=True)
                total = plus(total, function(np.divide(x, n, out=np.zeros_like(x), where=n > 0)))
        yield from pack(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for data in b.column(0).to_pylist():
                total = plus(total, open_(data))
        yield from pack(total)

    total = None
    for r in df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(first, "b binary").repartition(8).mapInArrow(again, "b binary").collect():
        total = plus(total, open_(bytes(r.b)))
    return total


def self_train(df: DataFrame, key: str, vector: str, start: DataFrame, tolerance: float = 0.001, rounds: int = 50) -> DataFrame:
    """(``key``, cluster): soft shares, target, weighted centres, until less than
    ``tolerance`` of the labels change (M13 without the encoder); warns where that is
    not met in ``rounds``.

    A round is two passes over the rows, which add up the clusters' mass and their
    weighted sums, k x d numbers whatever the rows; labels under the old and the new
    centres are compared on the way, so none are kept."""
    import warnings

    import numpy as np

    rows = start.orderBy("cluster").collect()  # the model's k centres
    names = [r.cluster for r in rows]

    def unit_rows(c: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(c, axis=1, keepdims=True)
        return np.divide(c, n, out=np.zeros_like(c), where=n > 0)

    def shares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        w = 1 / (1 + np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))
        return w / w.sum(1, keepdims=True)

    centres, before = np.array([r.centre for r in rows], float), None
    for _ in range(rounds):
        c, old = unit_rows(centres), before

        def mass(x: np.ndarray, c=c, old=old) -> list:
            moved = 0 if old is None else int(((x @ c.T).argmax(1) != (x @ old.T).argmax(1)).sum())
            return [shares(x, c).sum(0), np.array([moved, len(x)])]

        total = _summed(df, vector, mass)
        if total is None:
            break
        f, (moved, n) = total
        if old is not None and moved < tolerance * n:
            break

        def weighted(x: np.ndarray, c=c, f=f) -> list:
            p = shares(x, c)
            q = p * p / f
            q /= q.sum(1, keepdims=True)
            return [q.T @ x, q.sum(0)]

        sums, q = _summed(df, vector, weighted)
        before, centres = c, sums / q[:, None]
    else:
        warnings.warn(f"self_train: labels still moved after {rounds} rounds")
    named = df.sparkSession.createDataFrame([(k, c.tolist()) for k, c in zip(names, centres)], f"cluster {start.schema['cluster'].dataType.simpleString()}, centre array<double>")
    return assign(df, key, vector, named).select(key, "cluster")


def davies_bouldin(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """One row (dbi) (M22): scatter and distances of centres.  Distances are worked out
    whole vectors at a time; the k centres travel as one array, against which each
    looks for its worst neighbour."""
    distance = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    centre = as_arrays(mean_vectors(df, cluster, vector), cluster, "_m")
    away = df.select(cluster, F.col(vector).alias("_v")).join(centre, cluster).groupBy(cluster).agg(F.avg(distance(F.col("_v"), F.col("_m"))).alias("s"), F.first("_m").alias("_m"))
    packed = away.agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "s", "_m")).alias("_all"))
    others = F.filter("_all", lambda o: o["k"] != F.col(cluster))
    worst = away.crossJoin(F.broadcast(packed)).select(F.array_max(F.transform(others, lambda o: F.try_divide(F.col("s") + o["s"], distance(F.col("_m"), o["_m"])))).alias("r"))
    return worst.agg(F.avg("r").alias("dbi"))


def tf_idf(posts: DataFrame, key: str) -> DataFrame:
    """(``key``, token, weight): 1 + ln tf, smoothed idf, rows of length 1 (M6)."""
    n = posts.select(key).distinct().agg(F.count("*").alias("n"))
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    raw = posts.join(df, "token").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(norm, key).select(key, "token", (F.col("w") / F.col("l")).alias("weight"))


def projected(df: DataFrame, vector: str, size: int = 768, seed: int = 42) -> DataFrame:
    """``df`` with ``vector`` brought to ``size`` positions: shorter ones get zeros, longer
    ones a random projection that depends on the seed and their length alone (F27)."""
    import numpy as np
    import pyarrow as pa

    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            for v in b.column(at).to_pylist():
                if v is not None and len(v) > size:
                    if len(v) not in known:
                        known[len(v)] = np.random.default_rng(seed).normal(size=(len(v), size)) / np.sqrt(size)
                    v = (np.asarray(v, float) @ known[len(v)]).tolist()
                out.append(None if v is None else [*v, *[0.0] * (size - len(v))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    kinds = ", ".join(f"`{f.name}` {'array<double>' if f.name == vector else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, kinds)
