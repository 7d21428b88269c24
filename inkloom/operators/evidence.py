"""Evidence for items and claims (survey A28, F23, H3, J9, J17, J24, J26, T8, T9, W16).

All of it is said in columns: sentences of a text are an array, greedy choices are
folds over a sorted array in the JVM, and texts meet over shared tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import citation_ids, grams, normalize, sentence_parts, tokens

MARK = r"\[\^\d+\]"


def words(c: Column) -> Column:
    """Distinct tokens of a text without its citations."""
    return F.array_distinct(tokens(F.regexp_replace(c, MARK, "")))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def total_length(parts: Column) -> Column:
    """Length of the parts joined by blanks."""
    return F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x)) + F.greatest(F.size(parts) - 1, F.lit(0))


def match_items(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """(topic, sent_id, status, fallback_id, hits) of ``items`` (topic, rank, sent_id,
    entities) against ``corpus`` (sent_id, sentence) (J9, A28).

    The first item of a topic and sentence counts.  Items none of whose entities
    stand in their sentence look for the sentence that holds most of them, the
    least id of equals.  An entity meets the sentences that hold its rarest pair of
    signs, or its only sign; a sentence's text is read once for all of them."""
    w = Window.partitionBy("topic", "sent_id").orderBy("rank")
    first = items.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("topic", "sent_id", F.coalesce("entities", F.array()).alias("entities"))
    joined = first.join(corpus, "sent_id", "left")
    hit = F.size(F.filter("entities", lambda e: F.contains(F.col("sentence"), e)))
    status = (
        F.when(F.col("sentence").isNull(), "INDEX_OUT_OF_RANGE").when(F.size("entities") == 0, "NO_KEYWORDS").when(hit == F.size("entities"), "FULL_MATCH").when(hit > 0, "PARTIAL_MATCH").otherwise("NO_MATCH")
    )
    told = joined.select("topic", "sent_id", "entities", status.alias("status"))
    lost = told.where("status = 'NO_MATCH'").select("topic", "sent_id", F.explode("entities").alias("e"))
    asked = lost.select("e").distinct().where(F.length("e") >= 1)
    own = asked.select("e", F.explode(F.when(F.length("e") == 1, F.array("e")).otherwise(F.array_distinct(grams(F.col("e"), 2, ".")))).alias("g"))
    held = corpus.where("sentence is not null").select(F.col("sent_id").alias("at"), "sentence")
    signs = F.concat(F.array_distinct(grams(F.col("sentence"), 2, ".")), F.array_distinct(grams(F.col("sentence"), 1, ".")))
    # only pairs that some entity has leave the tasks
    places = held.select("at", F.explode(signs).alias("g")).join(own.select("g").distinct(), "g", "left_semi")
    often = own.join(places.groupBy("g").agg(F.count("*").alias("n")), "g", "left").groupBy("e").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    near = places.join(often, "g").groupBy("at").agg(F.collect_set("e").alias("es"))
    holds = near.join(held, "at").select("at", F.explode(F.filter("es", lambda e: F.contains(F.col("sentence"), e))).alias("e"))
    score = lost.join(holds, "e").groupBy("topic", "sent_id", "at").agg(F.count("*").alias("hits"))
    best = score.groupBy("topic", "sent_id").agg(F.max_by(F.struct("at", "hits"), F.struct(F.col("hits"), -F.col("at"))).alias("b"))
    best = best.where("b.at <> sent_id").select("topic", "sent_id", F.col("b.at").alias("fallback_id"), F.col("b.hits").alias("hits"))
    out = told.drop("entities").join(best, ["topic", "sent_id"], "left")
    return out.withColumn("status", F.when(F.col("fallback_id").isNotNull(), "NO_MATCH_BY_INDEX").otherwise(F.col("status")))


def excerpts(df: DataFrame, claim: str, passage: str, numbers: Column, name: str = "excerpt", most: int = 900, best: int = 4, share: float = 0.65) -> DataFrame:
    """``df`` with the sentences of ``passage`` that say most of ``claim``, with their
    neighbours, in their order (T8).

    A sentence weighs its tokens of the claim, their share, and the claim's numbers in
    it.  The best ``best`` that have any weight join in, each with both neighbours,
    until ``share`` of the room is used; a sentence with a number of the claim is always
    among them.  A passage without a weighty sentence gives its beginning."""
    squeezed = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    told = lambda x: F.size(F.filter(numbers, lambda n: F.contains(squeezed(x), n)))
    df = df.withColumns({"_s": sentence_parts(F.col(passage)), "_q": words(F.col(claim))})
    weight = lambda x: shared(F.col("_q"), words(x)) * (1 + 3.0 / F.greatest(F.size("_q"), F.lit(1))) + 8.0 * told(x)
    df = df.withColumn("_o", F.array_sort(F.transform("_s", lambda x, i: F.struct((-weight(x)).alias("w"), (-i).alias("i"), (told(x) > 0).alias("told")))))
    around = lambda i: F.filter(F.array(i - 1, i, i + 1), lambda k: (k >= 0) & (k < F.size("_s")))
    text = lambda at: F.transform(F.array_sort(at), lambda k: F.get(F.col("_s"), k))
    first = F.transform(F.slice(F.filter("_o", lambda o: o["told"]), 1, 1), lambda o: -o["i"])
    start = F.struct(first.alias("at"), F.lit(False).alias("full"))

    def join_in(acc: Column, o: Column) -> Column:
        more = F.array_union(acc["at"], around(-o["i"]))
        skip = acc["full"] | (o["w"] >= 0)
        return F.struct(F.when(skip, acc["at"]).otherwise(more).alias("at"), F.when(skip, acc["full"]).otherwise(total_length(text(more)) >= share * most).alias("full"))

    df = df.withColumn("_at", F.aggregate(F.slice("_o", 1, best), start, join_in)["at"])
    chosen = F.when(F.size("_at") > 0, F.array_join(text(F.col("_at")), " ")).otherwise(normalize(F.col(passage)))
    return df.withColumn(name, F.left(chosen, F.lit(most))).drop("_s", "_q", "_o", "_at")


def snippets(cited: DataFrame, evidence: DataFrame, key: str = "ref", most: int = 880, enough: int = 760, count: int = 8, cut: int = 900) -> DataFrame:
    """(``key``, snippet) of ``cited`` (key, pos, sentence) and ``evidence`` (key, pos,
    text): the evidence sentences that best match a sentence citing them (T9).

    ``key`` is a reference of one article, so both sides are bounded.  Sentences meet
    over shared tokens; of each evidence sentence only its best score is kept before
    the greedy fold, which skips what exceeds ``most`` and stops at ``enough``."""
    queries = cited.where("sentence is not null").select(key, F.col("pos").alias("c"), words(F.col("sentence")).alias("q"))
    asked = queries.select(key, "c", F.size("q").alias("n"), F.explode("q").alias("token"))
    parts = evidence.where("text is not null").select(key, "pos", F.posexplode(sentence_parts(F.col("text"), 18)).alias("k", "s"))
    own = parts.groupBy(key, "s").agg(F.min(F.struct("pos", "k")).alias("at"))
    meets = own.select(key, "s", "at", F.explode(words(F.col("s"))).alias("token")).join(asked, [key, "token"]).groupBy(key, "s", "at", "c").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    score = F.col("m") + 2.0 * F.col("m") / F.greatest(F.col("n"), F.lit(1))
    best = meets.groupBy(key, "s").agg(F.min(F.struct((-score).alias("w"), "c", "at")).alias("o"))
    ranked = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "s"))).alias("ranked"))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def take(acc: Column, x: Column) -> Column:
        n = F.length(x["s"]) + (F.size(acc["out"]) > 0).cast("int")
        skip = (acc["used"] >= enough) | (F.size(acc["out"]) >= count) | ((F.size(acc["out"]) > 0) & (acc["used"] + n > most))
        return F.struct(F.when(skip, acc["out"]).otherwise(F.array_append(acc["out"], x["s"])).alias("out"), F.when(skip, acc["used"]).otherwise(acc["used"] + n).alias("used"))

    folded = ranked.select(key, F.array_join(F.aggregate("ranked", empty, take)["out"], " ").alias("_text"))
    plain = evidence.where("text is not null").groupBy(key).agg(F.min_by("text", "pos").alias("_first"))
    out = cited.select(key).unionByName(plain.select(key)).distinct().join(folded, key, "left").join(plain, key, "left")
    return out.select(key, F.left(F.coalesce("_text", normalize(F.col("_first")), F.lit("")), F.lit(cut)).alias("snippet"))


def grounded(articles: DataFrame, chunks: DataFrame, key: str = "doc_id", least: int = 4, shortest: int = 14) -> DataFrame:
    """(``key``, line, pos, sentence, ref) of ``articles`` (key, text): an uncited
    sentence gets the chunk of ``chunks`` (key, ord, ref, text) that shares most tokens,
    ``least`` at least; of equals the reference used least so far in the article (J17).

    Scores come from a join over tokens within the article; only the choice among
    equals depends on what came before, and is a fold over the article's sentences
    with a map of uses."""
    lines = articles.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    body = lines.withColumn("part", F.when(F.trim("raw").rlike(r"^[#|]") | (F.trim("raw") == ""), F.array("raw")).otherwise(F.split("raw", r"(?<=[。！？])(?!$)")))
    rows = body.select(key, "line", F.posexplode("part").alias("pos", "sentence"))
    bare = ~F.col("sentence").rlike(MARK) & ~F.trim("sentence").rlike(r"^[#|]") & (F.length(F.regexp_replace("sentence", r"(?U)\W", "")) >= shortest)
    asked = rows.where(bare).select(key, "line", "pos", F.explode(words(F.col("sentence"))).alias("token"))
    held = chunks.where("text is not null").select(key, "ord", "ref", F.explode(words(F.col("text"))).alias("token"))
    n = asked.join(held, [key, "token"]).groupBy(key, "line", "pos", "ord", "ref").agg(F.count("*").alias("n"))
    per = n.groupBy(key, "line", "pos", "ref").agg(F.max("n").alias("n"), F.min_by("ord", F.struct(-F.col("n"), "ord")).alias("ord")).where(F.col("n") >= least)
    top = per.groupBy(key, "line", "pos").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "ord", "ref"))).alias("all"))
    equal = top.select(key, "line", "pos", F.transform(F.filter("all", lambda x: x["m"] == -F.col("n")), lambda x: F.struct(x["ord"].alias("ord"), x["ref"].alias("ref"))).alias("equal"))
    used = articles.select(key, F.explode(citation_ids(F.col("text"))).alias("ref")).groupBy(key, "ref").agg(F.count("*").cast("int").alias("n"))
    used = used.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ref").cast("long"), "n"))).alias("used"))
    turn = equal.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "pos", "equal"))).alias("turns")).join(used, key, "left")
    none = F.create_map().cast("map<bigint,int>")
    start = F.struct(F.coalesce("used", none).alias("used"), F.array().cast("array<struct<line:int,pos:int,ref:bigint>>").alias("out"))

    def choose(acc: Column, t: Column) -> Column:
        count = lambda ref: F.coalesce(F.try_element_at(acc["used"], ref.cast("long")), F.lit(0))
        best = F.array_min(F.transform(t["equal"], lambda x: F.struct(count(x["ref"]).alias("n"), x["ord"].alias("ord"), x["ref"].cast("long").alias("ref"))))
        rest = F.map_filter(acc["used"], lambda k, _: k != best["ref"])
        return F.struct(F.map_concat(rest, F.create_map(best["ref"], best["n"] + 1)).alias("used"), F.array_append(acc["out"], F.struct(t["line"].alias("line"), t["pos"].alias("pos"), best["ref"].alias("ref"))).alias("out"))

    chosen = turn.select(key, F.explode(F.aggregate("turns", start, choose)["out"]).alias("o")).select(key, "o.*")
    return rows.join(chosen, [key, "line", "pos"], "left")


def with_citations(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, text) of ``grounded`` rows: the reference stands before the end mark."""
    mark = F.concat(F.lit("[^"), F.col("ref").cast("string"), F.lit("]"))
    ended = F.right("sentence", F.lit(1)).isin("。", "！", "？")
    said = F.when(F.col("ref").isNull(), F.col("sentence")).when(ended, F.concat(F.expr("substring(sentence, 1, length(sentence) - 1)"), mark, F.right("sentence", F.lit(1)))).otherwise(F.concat("sentence", mark))
    lines = sentences.groupBy(key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))), lambda x: x["t"]), "").alias("t"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def interleaved(df: DataFrame, group: str, lists: str, pos: str, item: str, most: int) -> DataFrame:
    """(``group``, items): first of each list, then second, …; a round ends at an item
    over the budget, later rounds still try (W16)."""
    all_ = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("round"), F.col(lists).alias("list"), F.col(item).alias("item")))).alias("x"))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(-1).cast("long").alias("over"))

    def take(acc: Column, x: Column) -> Column:
        at, n = x["round"].cast("long"), F.length(x["item"])
        skip, full = acc["over"] == at, acc["used"] + n > most
        return F.struct(
            F.when(skip | full, acc["out"]).otherwise(F.array_append(acc["out"], x["item"])).alias("out"),
            F.when(skip | full, acc["used"]).otherwise(acc["used"] + n).alias("used"), F.when(~skip & full, at).otherwise(acc["over"]).alias("over"),
        )

    return all_.select(group, F.aggregate("x", empty, take)["out"].alias("items"))


def even_split(df: DataFrame, order: str, groups: int) -> DataFrame:
    """``df`` with grp: even shares in order, the rest to the last (J26).  Rows are
    numbered range by range, so no task orders all of them."""
    from .sequence import numbered

    n = F.broadcast(df.agg(F.greatest(F.floor(F.count("*") / groups), F.lit(1)).alias("_share")))
    placed = numbered(df, [order], "_at").crossJoin(n)
    return placed.withColumn("grp", F.least(F.floor(F.col("_at") / F.col("_share")), F.lit(groups - 1)).cast("int")).drop("_at", "_share")


def mixes(options: Column, top: int = 5, sure: int = 3, weight: float = 1.0, most: int = 100) -> Column:
    """array<struct<words, weight>>: combinations of the words that may stand for each
    part of a name (array<array<struct<word, weight>>>), weights added; the number of
    combinations is bounded by a parameter, as it is in the survey (J24)."""
    empty = F.array(F.struct(F.array().cast("array<string>").alias("words"), F.lit(0.0).alias("weight")))

    def add(acc: Column, part: Column) -> Column:
        ranked = F.slice(F.array_sort(F.transform(part, lambda x, i: F.struct((-x["weight"]).alias("w"), i.alias("i"), x["word"].alias("word")))), 1, top)
        kept = F.filter(ranked, lambda x, i: (i < sure) | (-x["w"] >= weight))
        return F.slice(F.flatten(F.transform(acc, lambda a: F.transform(kept, lambda k: F.struct(F.array_append(a["words"], k["word"]).alias("words"), (a["weight"] - k["w"]).alias("weight"))))), 1, most)

    return F.filter(F.aggregate(options, empty, add), lambda x: F.size(x["words"]) > 0)


def evidence_blocks(df: DataFrame, group: str, order: str) -> DataFrame:
    """(``group``, evidence, refs) of chunks (ref_id, title, url, text) (H3)."""
    block = F.format_string("[证据 ^%s]\n标题：%s\n来源：%s\n内容：%s", F.col("ref_id").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), "text")
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))).alias("x"), F.array_sort(F.collect_set("ref_id")).alias("refs"))
    return g.select(group, F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("evidence"), "refs")


def compact(texts: Column, most: int, steps: Sequence[int] = (2000, 1200, 800, 500, 300)) -> Column:
    """Longest cut of all texts at which their sum fits, else an even share."""
    at = lambda n: F.transform(texts, lambda t: F.left(t, n))
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, t: s + F.length(t))
    share = F.greatest(F.lit(1), F.floor(F.lit(most) / F.greatest(F.size(texts), F.lit(1)))).cast("int")
    return F.coalesce(*(F.when(size(at(F.lit(n))) <= most, at(F.lit(n))) for n in steps), at(share))
