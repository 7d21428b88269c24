"""Vector, cluster-measure and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import graph, stats, vectors
from .common import registry, table

QUERIES, SQL, query = registry()

#: DuckDB: unit vectors, centres by label, nearest centre.
UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"
LONG = "l AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY ALL)"
CENTRES = f"{LONG}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY label), k AS (SELECT label AS cluster, pos, m / n AS m FROM c JOIN n USING (label))"
COS = f"{CENTRES}, w AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM l GROUP BY vec_id), s AS (SELECT vec_id, l.label, cluster, sum(x * k.m) / max(n) AS cos FROM l JOIN k USING (pos) JOIN w USING (vec_id) GROUP BY ALL)"
ASSIGN = f"{COS}, a AS (SELECT vec_id, label, arg_max(cluster, struct_pack(c := round(cos, 9), b := -cluster)) AS cluster, max(cos) AS cos FROM s GROUP BY ALL)"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def _centres(spark, sf_dir) -> DataFrame:
    m = vectors.mean_vectors(_embeddings(spark, sf_dir), "label", "embedding")
    return vectors.as_arrays(m, "label", "centre").withColumnRenamed("label", "cluster")


def _assigned(spark, sf_dir) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return vectors.assign(e, "vec_id", "embedding", _centres(spark, sf_dir)).join(e.select("vec_id", "label"), "vec_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, CAST(1.0 AS DOUBLE) AS dot_self FROM embeddings")
def l2_normalised_embeddings(spark, sf_dir):
    """Norm before and after."""
    e = _embeddings(spark, sf_dir)
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    u = vectors.unit(F.col("embedding"))
    return e.select("vec_id", F.round(n, 5).alias("norm"), F.round(vectors.dot(u, u), 6).alias("dot_self"))


@query(f"WITH {LONG} SELECT label, CAST(pos AS INTEGER) AS pos, round(m, 6) AS value FROM c")
def centroids_by_label(spark, sf_dir):
    """Mean vector of each label (A5)."""
    return vectors.mean_vectors(_embeddings(spark, sf_dir), "label", "embedding").withColumn("value", F.round("value", 6))


@query(f"WITH {ASSIGN} SELECT vec_id, cluster, round(cos, 6) AS cos FROM a")
def nearest_centroid_assign(spark, sf_dir):
    """Nearest centre by cosine."""
    return _assigned(spark, sf_dir).select("vec_id", "cluster", F.round("cos", 6).alias("cos"))


@query(f"""WITH {COS}, r AS (SELECT vec_id, cluster, 1 / (1 + greatest(2 - 2 * cos, 0)) AS w FROM s), p AS (SELECT vec_id, cluster, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM r), f AS (SELECT cluster, sum(p) AS f FROM p GROUP BY cluster),
q AS (SELECT vec_id, cluster, p, p * p / f AS w FROM p JOIN f USING (cluster)) SELECT vec_id, cluster, round(p, 5) AS p, round(w / sum(w) OVER (PARTITION BY vec_id), 5) AS q FROM q""")
def student_t_soft_assign(spark, sf_dir):
    """Soft shares and their target."""
    soft = vectors.soft_target(_embeddings(spark, sf_dir), "vec_id", "embedding", _centres(spark, sf_dir))
    return soft.select("vec_id", "cluster", F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


@query(f"WITH {ASSIGN} SELECT label, cluster, count(*) AS n FROM a GROUP BY ALL")
def contingency_matrix(spark, sf_dir):
    """Labels against clusters (A10)."""
    return stats.contingency(_assigned(spark, sf_dir), "label", "cluster")


@query(f"""WITH {ASSIGN}, t AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM a GROUP BY ALL), x AS (SELECT label, sum(n) AS a FROM t GROUP BY label), y AS (SELECT cluster, sum(n) AS b FROM t GROUP BY cluster), z AS (SELECT sum(n) AS t FROM t),
p AS (SELECT sum(n * (n - 1) / 2) AS s FROM t), pa AS (SELECT sum(a * (a - 1) / 2) AS sa FROM x), pb AS (SELECT sum(b * (b - 1) / 2) AS sb FROM y),
m AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi, sum(n * n / b / t) AS bp, sum(n * n / a / t) AS br FROM t JOIN x USING (label) JOIN y USING (cluster), z), ha AS (SELECT -sum(a / t * ln(a / t)) AS ha FROM x, z), hb AS (SELECT -sum(b / t * ln(b / t)) AS hb FROM y, z)
SELECT round(100 * (s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 5) AS ari, round(100 * 2 * mi / (ha + hb), 5) AS nmi, round(100 * bp, 5) AS b3_p, round(100 * br, 5) AS b3_r, round(100 * 2 * bp * br / (bp + br), 5) AS b3_f1 FROM p, pa, pb, m, ha, hb, z""")
def cluster_external_metrics(spark, sf_dir):
    """ARI, NMI and B-cubed."""
    m = stats.external_measures(stats.contingency(_assigned(spark, sf_dir), "label", "cluster"))
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@query(f"WITH {ASSIGN}, t AS (SELECT label, cluster, count(*) AS n FROM a GROUP BY ALL) SELECT cluster, arg_max(label, struct_pack(n := n, l := -label)) AS label, max(n) AS n FROM t GROUP BY cluster")
def cluster_majority_labels(spark, sf_dir):
    """Each cluster's most frequent label."""
    return stats.majority_labels(stats.contingency(_assigned(spark, sf_dir), "label", "cluster"))


@query(f"WITH {ASSIGN} SELECT cluster, count(*) AS n, count(*) < 5 AS is_small FROM a GROUP BY cluster")
def cluster_size_support(spark, sf_dir):
    """Cluster sizes."""
    return stats.cluster_sizes(_assigned(spark, sf_dir), "cluster")


@query(f"""WITH {LONG}, d AS (SELECT label, vec_id, sqrt(sum((x - m) * (x - m))) AS d FROM l JOIN c USING (label, pos) GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM d GROUP BY label),
m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS m FROM c a JOIN c b USING (pos) WHERE a.label <> b.label GROUP BY ALL), r AS (SELECT i, max((x.s + y.s) / m) AS r FROM m JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i) SELECT round(avg(r), 5) AS dbi FROM r""")
def davies_bouldin(spark, sf_dir):
    """Davies–Bouldin index of the labels."""
    return vectors.davies_bouldin(_embeddings(spark, sf_dir), "vec_id", "embedding", "label").select(F.round("dbi", 5).alias("dbi"))


@query(f"WITH {ASSIGN}, r AS (SELECT cluster, vec_id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY cluster ORDER BY round(cos, 6) DESC, vec_id) AS rn FROM a) SELECT cluster, vec_id, cos, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 10")
def cluster_top_items(spark, sf_dir):
    """Ten items nearest to each centre."""
    from ..operators.sequence import top_k

    a = _assigned(spark, sf_dir).withColumn("cos", F.round("cos", 6))
    return top_k(a, ["cluster"], [F.desc("cos"), "vec_id"], 10).select("cluster", "vec_id", "cos", "rn")


@query()
def kmeans_spherical(spark, sf_dir):
    """Cosine k-means."""
    return vectors.spherical_kmeans(_embeddings(spark, sf_dir), "vec_id", "embedding", 10, runs=5)


@query()
def self_trained_clusters(spark, sf_dir):
    """Self-training from the k-means centres."""
    e = _embeddings(spark, sf_dir)
    first = vectors.spherical_kmeans(e, "vec_id", "embedding", 10)
    centres = vectors.as_arrays(vectors.mean_vectors(e.join(first, "vec_id"), "cluster", "embedding"), "cluster", "centre")
    return vectors.self_train(e, "vec_id", "embedding", centres)


@query("""WITH e AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT label, count(*) AS n FROM e GROUP BY label), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS d FROM e a, e b GROUP BY ALL),
m AS (SELECT vec_id, d.label, other, CASE WHEN d.label = other THEN d / greatest(n - 1, 1) ELSE d / n END AS m FROM d JOIN n ON n.label = other), s AS (SELECT vec_id, label, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b FROM m GROUP BY ALL)
SELECT vec_id, round(CASE WHEN n.n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 7) AS s FROM s JOIN n USING (label)""")
def silhouette_sampled(spark, sf_dir):
    """Silhouette of 10,000 rows at most, the reference's sample (M22); the SQL states
    it of tables up to that size."""
    return stats.silhouette(_embeddings(spark, sf_dir), "vec_id", "embedding", "label").withColumn("s", F.round("s", 7) + F.lit(0.0))


def _tuples(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "feature_bank", "tuple_id", *columns).dropDuplicates(["tuple_id"])


@query("""WITH f AS (SELECT DISTINCT tuple_id, topic_id, verb_sense, tuple_freq FROM feature_bank), v AS (SELECT topic_id, split_part(verb_sense, '.', 1) AS term, sum(tuple_freq) AS local FROM f GROUP BY ALL), w AS (SELECT term, sum(local) AS freq FROM v GROUP BY term),
s AS (SELECT topic_id, term, local, freq, local * log10(freq) AS salience FROM v JOIN w USING (term)), n AS (SELECT *, count(*) FILTER (salience > 0) OVER (PARTITION BY topic_id) AS pos FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY salience DESC, term) AS r FROM n WHERE salience > 0 AND term NOT IN ('控制'))
SELECT topic_id, term, CAST(local AS BIGINT) AS local, CAST(freq AS BIGINT) AS global, round(salience, 6) AS salience FROM r WHERE r <= greatest(1, floor(pos * 0.8)) AND local >= 3""")
def salient_terms_top_ratio(spark, sf_dir):
    """Salient verbs of each topic."""
    t = _tuples(spark, sf_dir, "topic_id", "verb_sense", "tuple_freq")
    local = t.groupBy("topic_id", F.substring_index("verb_sense", ".", 1).alias("term")).agg(F.sum("tuple_freq").alias("local"))
    world = local.groupBy("term").agg(F.sum("local").alias("freq"))
    stop = spark.createDataFrame([("控制",)], "term string")
    out = graph.top_ratio(graph.salience(local, world), "topic_id", stop)
    return out.select("topic_id", "term", "local", "global", F.round("salience", 6).alias("salience"))


@query("""WITH f AS (SELECT DISTINCT tuple_id, verb_sense, obj_head, tuple_freq, len(ents) > 0 AS has FROM feature_bank), g AS (SELECT verb_sense, obj_head, count(*) AS n, CAST(sum(tuple_freq) AS BIGINT) AS freq, max(has) AS has, min(tuple_id) AS first_id FROM f WHERE obj_head IS NOT NULL GROUP BY ALL) SELECT verb_sense, obj_head, n, freq, first_id FROM g WHERE has""")
def tuple_vocabulary(spark, sf_dir):
    """Verb-object pairs with an entity, counted over all."""
    t = _tuples(spark, sf_dir, "verb_sense", "obj_head", "tuple_freq", "ents").where("obj_head is not null")
    g = t.groupBy("verb_sense", "obj_head").agg(F.count("*").alias("n"), F.sum("tuple_freq").alias("freq"), F.max(F.size("ents") > 0).alias("has"), F.min("tuple_id").alias("first_id"))
    return g.where("has").drop("has")


PAIRS = "e AS (SELECT DISTINCT verb_sense AS src, obj_head AS dst FROM feature_bank WHERE obj_head IS NOT NULL AND verb_sense IS NOT NULL), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)"


def _pairs(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "feature_bank", "verb_sense", "obj_head").where("verb_sense is not null and obj_head is not null")
    return graph.undirected(t.select(F.col("verb_sense").alias("src"), F.col("obj_head").alias("dst")))


@query(f"WITH {PAIRS} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY node")
def cooccurrence_degree(spark, sf_dir):
    """Degrees in the verb-object graph."""
    return graph.degrees(_pairs(spark, sf_dir))


@query(f"WITH {PAIRS}, d AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p), f AS (SELECT * FROM d UNION ALL SELECT DISTINCT src, src FROM d), g AS (SELECT src, count(*) AS d FROM f GROUP BY src) SELECT f.src, f.dst, round(1 / sqrt(x.d * y.d), 9) AS w FROM f JOIN g x ON x.src = f.src JOIN g y ON y.src = f.dst")
def adjacency_normalised(spark, sf_dir):
    """Symmetric normalisation."""
    return graph.normalised(_pairs(spark, sf_dir)).withColumn("w", F.round("w", 9))


@query(f"WITH {PAIRS}, d AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p), f AS (SELECT * FROM d UNION ALL SELECT DISTINCT src, src FROM d), g AS (SELECT src, count(*) AS d FROM f GROUP BY src) SELECT f.dst AS node, 0 AS pos, round(sum(length(f.src) / sqrt(x.d * y.d)), 6) AS value FROM f JOIN g x ON x.src = f.src JOIN g y ON y.src = f.dst GROUP BY f.dst")
def propagated_features(spark, sf_dir):
    """One step of propagation."""
    w = graph.normalised(_pairs(spark, sf_dir))
    x = w.select(F.col("src").alias("node")).distinct().select("node", F.lit(0).alias("pos"), F.length("node").cast("double").alias("value"))
    return graph.propagate(w, x).withColumn("value", F.round("value", 6))


@query("WITH f AS (SELECT DISTINCT tuple_id, verb_sense, summarized_emb FROM feature_bank WHERE summarized_emb IS NOT NULL), l AS (SELECT verb_sense, unnest(range(len(summarized_emb))) AS pos, CAST(unnest(summarized_emb) AS DOUBLE) AS x FROM f) SELECT verb_sense, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM l GROUP BY ALL")
def sense_mean_vectors(spark, sf_dir):
    """Mean vector of each verb sense."""
    t = _tuples(spark, sf_dir, "verb_sense", "summarized_emb").where("summarized_emb is not null")
    return vectors.mean_vectors(t, "verb_sense", "summarized_emb").withColumn("value", F.round("value", 6))


@query("""WITH f AS (SELECT DISTINCT tuple_id, CAST(vs_emb AS DOUBLE[]) AS v FROM feature_bank), j AS (SELECT DISTINCT left_id, right_id FROM judged_pairs), p AS (SELECT left_id, right_id, a.v AS a, b.v AS b FROM j JOIN f a ON a.tuple_id = left_id JOIN f b ON b.tuple_id = right_id),
c AS (SELECT left_id, right_id, CASE WHEN len(a) = len(b) THEN list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) / nullif(sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x))), 0) END AS c FROM p) SELECT left_id, right_id, round(coalesce(c, 0), 5) + 0.0::DOUBLE AS cos FROM c""")
def judged_cosines(spark, sf_dir):
    """Cosine of each judged pair in one view."""
    from ..operators.text import cosine

    f = _tuples(spark, sf_dir, "vs_emb")
    j = table(spark, sf_dir, "judged_pairs", "left_id", "right_id").distinct()
    p = j.join(f.select(F.col("tuple_id").alias("left_id"), F.col("vs_emb").alias("a")), "left_id").join(f.select(F.col("tuple_id").alias("right_id"), F.col("vs_emb").alias("b")), "right_id")
    return p.select("left_id", "right_id", (F.round(cosine(F.col("a"), F.col("b")), 5) + F.lit(0.0)).alias("cos"))


@query("WITH f AS (SELECT DISTINCT tuple_id, topic_id, obj_head FROM feature_bank), s AS (SELECT topic_id, obj_head FROM f WHERE obj_head IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT tuple_id, obj_head IS NOT NULL AND (topic_id, obj_head) IN (SELECT topic_id, obj_head FROM s) AS salient FROM f")
def salient_flags(spark, sf_dir):
    """Whether a unit's object is salient in its topic."""
    t = _tuples(spark, sf_dir, "topic_id", "obj_head")
    s = t.where("obj_head is not null").groupBy("topic_id", "obj_head").count().where("count >= 3").select("topic_id", "obj_head", F.lit(True).alias("s"))
    return t.join(s, ["topic_id", "obj_head"], "left").select("tuple_id", F.coalesce("s", F.lit(False)).alias("salient"))
