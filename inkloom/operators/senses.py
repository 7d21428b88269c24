"""Choice of word senses over tables (survey A36, F15-F18, H20, J5, M26, P16, P19, T2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .text import char_jaccard, cosine

#: Outcomes of a choice that is none.
NO_LEMMA, NO_SENSE, NO_VECTOR = -1, -2, -3


def normalized_token(c: Column) -> Column:
    """Lower case, without signs that are no word signs, without white space at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))


def rank_overlap(a: Column, b: Column, p: float = 0.9) -> Column:
    """Rank-biased overlap of two lists, extrapolated from their common depth; 0 where
    one is empty (F16)."""
    depth = F.least(F.size(a), F.size(b))
    both = lambda d: F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d)))
    total = F.aggregate(F.sequence(F.lit(1), depth), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d) * both(d) / d)
    return F.when(depth > 0, (1 - p) / p * total + both(depth) / depth * F.pow(F.lit(p), depth)).otherwise(0.0)


def sign_overlap(a: Column, b: Column, most: int = 5) -> Column:
    """Best overlap of signs of any two of the first words."""
    each = F.flatten(F.transform(F.slice(a, 1, most), lambda x: F.transform(F.slice(b, 1, most), lambda y: char_jaccard(x, y))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def sense_score(vector: Column, sense_vector: Column, words: Column, sense_words: Column) -> Column:
    """0.6 cosine + 0.3 rank overlap + 0.1 best overlap of signs."""
    return 0.6 * cosine(vector, sense_vector) + 0.3 * rank_overlap(words, sense_words) + 0.1 * sign_overlap(words, sense_words)


def resolve(mentions: DataFrame, senses: DataFrame) -> DataFrame:
    """(mention, sense_id, score) of ``mentions`` (mention, lemma, vector, words) against
    ``senses`` (lemma, sense_id, vector, words): the best sense of the lemma, the first
    of equals (J5, M26).

    A lemma's senses are a handful, so they travel as one array and each mention is
    scored in place.  Negative ids say why there is none: no lemma, a lemma without
    senses, no vector to compare.  A lemma of one sense takes it unseen."""
    held = senses.groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("sense_id", F.col("vector").alias("v"), F.col("words").alias("w")))).alias("_s"))
    joined = mentions.join(held, "lemma", "left")
    scored = F.transform("_s", lambda s: F.struct(sense_score(F.col("vector"), s["v"], F.coalesce("words", F.array().cast("array<string>")), F.coalesce(s["w"], F.array().cast("array<string>"))).alias("score"), (-s["sense_id"]).alias("back")))
    best = F.array_max(scored)
    sense = (
        F.when(F.coalesce(F.trim("lemma"), F.lit("")) == "", NO_LEMMA).when(F.col("_s").isNull(), NO_SENSE).when(F.size("_s") == 1, F.get(F.col("_s"), F.lit(0))["sense_id"])
        .when(F.col("vector").isNull(), NO_VECTOR).otherwise(-best["back"])
    )
    return joined.select("mention", sense.cast("int").alias("sense_id"), F.when(sense >= 0, F.coalesce(best["score"], F.lit(0.0))).alias("score"))


def sense_features(examples: DataFrame, sense: Sequence[str], example: str, words: str) -> DataFrame:
    """(sense, lemma, score): sum of 1 / ln(1 + rank) over the examples, with a word's
    first rank, from 1, in each (A36)."""
    each = examples.select(*sense, example, F.posexplode(words).alias("at", "lemma"))
    first = each.groupBy(*sense, example, "lemma").agg(F.min("at").alias("at"))
    return first.groupBy(*sense, "lemma").agg(F.sum(1 / F.log(F.lit(2.0) + F.col("at"))).alias("score"))


def rekeyed(entries: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Dictionary entries (lemma, sense_id, examples) by bare lemma, with ``generated``
    examples in front of their own (H20)."""
    bare = F.element_at(F.split("lemma", "-"), 1)
    out = entries.withColumn("lemma", bare)
    if generated is None:
        return out
    new = generated.select(bare.alias("lemma"), "sense_id", F.col("examples").alias("_new"))
    none = F.array().cast("array<string>")
    return out.join(new, ["lemma", "sense_id"], "left").withColumn("examples", F.concat(F.coalesce("_new", none), F.coalesce("examples", none))).drop("_new")


def worth_resolving(entries: DataFrame) -> DataFrame:
    """Entries (lemma, senses) of nouns, and of verbs with more than one sense."""
    return entries.where((F.size("senses") > 1) | ~F.col("lemma").endswith("-v"))


def is_verb(word: Column, known: Sequence[str], suffixes: Sequence[str], prefixes: Sequence[str], tag: Column | None = None) -> Column:
    """A listed word, else by suffix, else by prefix, else by its tag."""
    test = word.isin(*known) if known else F.lit(False)
    for s in suffixes:
        test = test | word.endswith(s)
    for p in prefixes:
        test = test | (word.startswith(p) & (F.length(word) > len(p)))
    return test if tag is None else test | F.coalesce(F.upper(tag).startswith("V"), F.lit(False))


def mask_candidates(masks: Column, most: int = 50) -> Column:
    """array<struct<word, weight>> of a word of several masked positions, each with its
    candidates (array<array<struct<word, weight>>>, best first): candidates of equal rank
    are put together, their weights by geometric mean (T2 behind its model)."""
    depth = F.least(F.lit(most), F.coalesce(F.array_min(F.transform(masks, lambda m: F.size(m))), F.lit(0)))
    at = lambda i: F.transform(masks, lambda m: F.get(m, i))
    weight = lambda i: F.exp(F.aggregate(at(i), F.lit(0.0), lambda s, x: s + F.log(F.greatest(x["weight"], F.lit(1e-12)))) / F.greatest(F.size(masks), F.lit(1)))
    word = lambda i: F.array_join(F.transform(at(i), lambda x: F.regexp_replace(x["word"], "^##", "")), "")
    ranks = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ranks, lambda i: F.struct(word(i).alias("word"), weight(i).alias("weight")))
