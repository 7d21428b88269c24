"""Term units and their graph (survey A1, A2, A7, A30, A31, J1, J2, M16-M18, M20, P7, P15, W2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def salience(local: DataFrame, world: DataFrame) -> DataFrame:
    """(…, term, local, global, salience): local count x log10 of the global one; a
    term missing there is looked up without quotes, else -1 (A1, A2, J1)."""
    w = world.select(F.col("term").alias("_t"), F.col("freq").alias("_f"))
    bare = F.regexp_replace("term", "^[\"']+|[\"']+$", "")
    joined = local.join(w, F.col("term") == F.col("_t"), "left").drop("_t").withColumnRenamed("_f", "_f1")
    joined = joined.join(w.withColumnRenamed("_f", "_f2"), bare == F.col("_t"), "left").drop("_t")
    g = F.coalesce("_f1", "_f2", F.lit(-1))
    return joined.withColumn("global", g).withColumn("salience", F.when(g > 0, F.col("local") * F.log10(g.cast("double"))).otherwise(0.0)).drop("_f1", "_f2")


def top_ratio(scored: DataFrame, group: str, stop: DataFrame, ratio: float = 0.8, least: int = 3) -> DataFrame:
    """Best terms of each group: as many as ``ratio`` of those with positive salience,
    counted before stop words go, then at least ``least`` occurrences (W2)."""
    w = Window.partitionBy(group)
    some = scored.withColumn("_pos", F.count(F.when(F.col("salience") > 0, 1)).over(w)).withColumn("_all", F.count("*").over(w))
    n = F.greatest(F.lit(1), F.floor(F.when(F.col("_pos") > 0, F.col("_pos")).otherwise(F.col("_all")) * ratio))
    some = some.withColumn("_n", n).where((F.col("salience") > 0) | (F.col("_pos") == 0)).join(stop, "term", "left_anti")
    ranked = some.withColumn("_r", F.row_number().over(w.orderBy(F.desc("salience"), "term"))).where("_r <= _n")
    return ranked.where(F.col("local") >= least).drop("_r", "_n", "_pos", "_all")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): each edge once, smaller end first, no loops."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def normalised(pairs: DataFrame) -> DataFrame:
    """(src, dst, w): symmetric normalisation with self loops."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    loops = both.select("src").distinct().select("src", F.col("src").alias("dst"))
    full = both.unionByName(loops)
    deg = full.groupBy("src").agg(F.count("*").alias("d"))
    w = full.join(deg.withColumnRenamed("d", "ds"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return w.select("src", "dst", (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def propagate(weights: DataFrame, features: DataFrame) -> DataFrame:
    """(node, pos, value): one step of feature propagation."""
    return weights.join(features.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "pos").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def modes(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): most frequent values, all of a tie."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.rank().over(Window.partitionBy(group).orderBy(F.desc("n")))).where("_r = 1").drop("_r")


#: Fixed value: weight of an edge between a unit's own parts.
OWN = 9.0


def evidence_edges(units: DataFrame, neighbours: DataFrame | None = None, language: str = "zh", least: float = 1.0) -> DataFrame:
    """(src, dst, weight) of ``units`` (sent_id, verb, object, entities): verb to object
    and verb to entity, an entity once a sentence, and a lexicon's ``neighbours`` (src,
    dst, weight, lang) of the wanted language and weight that touch a node (M16, P15).
    Equal edges keep their greatest weight."""
    u = units.where("verb is not null")
    own = u.where("object is not null").select(F.col("verb").alias("src"), F.col("object").alias("dst"))
    named = u.select("sent_id", "verb", F.explode("entities").alias("dst")).where("dst is not null").groupBy("sent_id", "dst").agg(F.min("verb").alias("src")).select("src", "dst")
    edges = own.unionByName(named).withColumn("weight", F.lit(OWN))
    if neighbours is not None:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
        near = neighbours.where((F.col("lang") == language) & (F.col("weight") >= least)).select("src", "dst", F.col("weight").cast("double").alias("weight"))
        edges = edges.unionByName(near.join(nodes, "src", "left_semi"))
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def average_degree(pairs: DataFrame) -> DataFrame:
    """One row (nodes, edges, average)."""
    return degrees(pairs).agg(F.count("*").alias("nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"), F.avg("degree").alias("average"))


def salience_flags(units: DataFrame, group: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Units of which any part is salient in their group, with the flags some and all;
    ``parts`` names a column and its salient values (group, column) (P7, J2)."""
    for name, salient in parts.items():
        units = units.join(salient.select(group, name).distinct().withColumn(f"_{name}", F.lit(True)), [group, name], "left")
    flags = [F.coalesce(f"_{n}", F.lit(False)) for n in parts]
    some, all_ = flags[0], flags[0]
    for f in flags[1:]:
        some, all_ = some | f, all_ & f
    return units.withColumns({"any_salient": some, "all_salient": all_}).where("any_salient").drop(*(f"_{n}" for n in parts))
