"""Joins and sums that build a bank of unit features (survey A6, A33, A35, A37, A38, H14, H18, H19, J3, J4, J6-J8, J10, J11, P5, P24, U6).

Every join is an equi-join on an id that Catalyst may place; the only arrays are those
of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import modes
from .sequence import dense_ids, numbered


def with_senses(units: DataFrame, senses: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units that have a sense, one each: the first by order of sense (J3).  A unit
    without one is left out."""
    one = senses.groupBy(key).agg(F.min("sense").alias("sense"))
    return units.join(one.where("sense is not null"), key)


def with_heads(units: DataFrame, heads: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Units with what is known of their object phrase's head, null where nothing is."""
    return units.join(heads.dropDuplicates([phrase]), phrase, "left")


def node_links(nodes: DataFrame, node: str, sentences: str) -> DataFrame:
    """(sent_id, node) of nodes with an array of sentence ids; negative ids stand for
    nodes without a sentence and are left out, a sentence named twice counts once (J6)."""
    return nodes.select(F.explode(F.array_distinct(sentences)).alias("sent_id"), node).where("sent_id >= 0")


def node_vectors(nodes: DataFrame, node: str, rows: DataFrame, at: str, vector: str) -> DataFrame:
    """(node, vector): the row of a table of vectors at each node's place in order of
    first appearance (J7)."""
    placed = dense_ids(nodes, node, at)
    return placed.join(rows.withColumnRenamed("row", "id"), "id").select(node, vector)


def zero_filled(df: DataFrame, other: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``df`` with ``vector`` of ``other``; zeros where it has none or one of another
    length (J8)."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return df.join(other.select(key, vector), key, "left").withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(zero))


def gold_items(items: DataFrame, labels: DataFrame, key: str, label: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Items with their label; those without or with an unknown one are dropped."""
    return items.join(labels.select(key, label), key, "left").where(F.col(label).isNotNull() & (F.upper(label) != unknown))


def node_types(links: DataFrame, node: str, sentence: str, types: DataFrame, label: str) -> DataFrame:
    """(node, label): the label of the sentence a node stands in most often, the least
    sentence of a tie (J11, A30)."""
    top = modes(links.where(F.col(sentence).isNotNull()), node, sentence)
    return top.groupBy(node).agg(F.min(sentence).alias(sentence)).join(types.select(sentence, label), sentence).select(node, label)


def expansion_sums(expansions: DataFrame, key: str, lemma: str, weight: str) -> DataFrame:
    """(key, lemma, weight): weights of equal words added up."""
    return expansions.where(F.col(lemma).isNotNull()).groupBy(key, lemma).agg(F.sum(weight).alias(weight))


def expansion_scores(words: DataFrame, key: str, lemma: str, rank: str, score: str) -> DataFrame:
    """(key, lemma, score): a word counts its score, or 1 / ln(2 + its rank from 0)
    where it has none; equal words of a mention are added up (A37)."""
    own = F.coalesce(F.col(score), 1 / F.log(F.lit(2.0) + F.col(rank)))
    return words.groupBy(key, lemma).agg(F.sum(own).alias("score"))


def outcome_counts(df: DataFrame, status: Column) -> DataFrame:
    """(status, n)."""
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def sense_outcome(chosen: Column) -> Column:
    """Outcome of a choice of sense: only numbers above 0 are a success, so the sense
    number 0 counts as an error, as negative codes do; none chosen was skipped (A35)."""
    return F.when(chosen.isNull(), "skipped").when(chosen > 0, "success").otherwise("error")


def classified(df: DataFrame, label: str) -> DataFrame:
    """One row (classified, unclassified)."""
    has = F.coalesce(F.trim(label), F.lit("")) != ""
    return df.agg(F.count_if(has).alias("classified"), F.count_if(~has).alias("unclassified"))


def kept_vocabulary(terms: DataFrame, term: str, stop: DataFrame, order: Sequence[str]) -> DataFrame:
    """``terms`` without stop words and pieces of words, numbered anew from 0."""
    kept = terms.where(~F.col(term).startswith("##")).join(stop.select(F.col(stop.columns[0]).alias(term)), term, "left_anti")
    return numbered(kept, order, "index")


def label_codes(df: DataFrame, label: str, at: str) -> DataFrame:
    """(label, code, n): labels numbered by first appearance, with their frequency."""
    return dense_ids(df.where(F.col(label).isNotNull()), label, at).withColumnRenamed("id", "code").join(df.groupBy(label).agg(F.count("*").alias("n")), label)


def relabelled(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys, n_labels) of rows that occur under different labels."""
    return df.groupBy(*keys).agg(F.count_distinct(label).alias("n_labels")).where("n_labels > 1")


def recovered_labels(rows: DataFrame, prefix: str, known: DataFrame) -> DataFrame:
    """``rows`` with the label of their prefix whose share of rows is the one noted in
    ``known`` (prefix, n, label): names cut to a prefix are told apart by their count (P24)."""
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy(prefix)))
    return counted.join(F.broadcast(known) if known.isLocal() else known, [prefix, "n"], "left").drop("n")


def allowed_entities(entities: Column, types: Sequence[str]) -> Column:
    """Entities (struct with label) of the wanted types (P5)."""
    return F.filter(entities, lambda e: e["label"].isin(*types))


def merged(left: Column, right: Column) -> Column:
    """Union of two maps; the right one's values win, null is an empty map."""
    a, b = (F.coalesce(m, F.map_from_arrays(F.slice(F.map_keys(x), 1, 0), F.slice(F.map_values(x), 1, 0))) for m, x in ((left, right), (right, left)))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def node_texts(nodes: DataFrame, sentences: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(node, text) of ``nodes`` (node, word, base): a base node has its own sentence
    (sentences: node, text); a derived one that of its least base neighbour with the
    neighbour's word replaced by its own, or its word in front where the word does not
    occur; its word alone where there is none (H19)."""
    own = nodes.where("base").join(sentences, "node", "left").select("node", F.coalesce("text", "word").alias("text"))
    near = neighbours.join(nodes.where("base").select(F.col("node").alias("other"), F.col("word").alias("other_word")), "other").groupBy("node").agg(F.min(F.struct("other", "other_word")).alias("o"))
    told = near.select("node", "o.*").join(sentences.select(F.col("node").alias("other"), "text"), "other", "left")
    derived = nodes.where("not base").join(told, "node", "left")
    said = F.when(F.contains("text", "other_word"), F.replace("text", "other_word", "word")).otherwise(F.concat_ws(" ", "word", "text"))
    return own.unionByName(derived.select("node", said.alias("text")))
