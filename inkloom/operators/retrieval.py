"""Chunks, term statistics, BM25, budgets and claim passages (survey A3, A4, T5, T6, F13, J16, W3, W4, W11-W13)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .text import is_boilerplate, normalize, token_count, tokens

#: Weights of the ranking.
K1, B, RELEVANCE, RELEVANCE_MOST, TITLE, QUERY_MOST = 1.35, 0.72, 0.35, 0.8, 0.25, 2


def postings(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """(keys, token, tf) (A4)."""
    # the outer form: the inner one makes the optimizer work the tokens out twice, to
    # filter empty lists first
    return df.select(*keys, F.explode_outer(tokens(text)).alias("token")).where("token is not null").groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def lengths(posts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return posts.groupBy(*keys).agg(F.sum("tf").alias("dl"))


def document_frequency(posts: DataFrame, n_docs: Column | int) -> DataFrame:
    """(token, df, idf) (A3); ``posts`` has one row per document and token."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    counted = posts.groupBy("token").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def arrays(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """(keys, dl, tokens): one row a document, nothing exploded; the length is counted
    by itself, so plans that need no tokens make none."""
    return df.select(*keys, token_count(text).alias("dl"), tokens(text).alias("tokens"))


def totals(docs: DataFrame) -> DataFrame:
    """One row (n, avgdl) of ``arrays``; documents without a token do not count."""
    return docs.where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def frequencies(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(token, df) of ``arrays``, of ``wanted`` (token) tokens only if given."""
    each = docs.select(F.explode_outer(F.array_distinct("tokens")).alias("token")).where("token is not null")
    return (each.join(wanted, "token", "left_semi") if wanted is not None else each).groupBy("token").agg(F.count("*").alias("df"))


def term_weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1.0))))


#: Query tokens up to which they are tested inside the tokens' array, before any row is made.
LITERAL = 5000


def asked_only(docs: DataFrame, queries: DataFrame, most: int = LITERAL) -> DataFrame:
    """``arrays`` without the tokens that no query has, written once: frequencies,
    lengths and counts are then read from this small table and the texts only once.
    Where the queries have more than ``most`` tokens nothing is cut here or written."""
    from ..session import kept

    wanted = [r.token for r in queries.select("token").distinct().limit(most + 1).collect()]
    if len(wanted) > most:
        return docs
    return kept(docs.withColumn("tokens", F.filter("tokens", lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>")), "asked-tokens")


def bm25(docs: DataFrame, keys: Sequence[str], queries: DataFrame, on: Sequence[str] = ("token",), k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, keys…, score) of ``arrays`` (docs) for ``queries`` (query_id, token,
    qtf).  ``on`` may add columns that a query and its documents share.

    The tokens are worked out once: those that no query has are cut inside their array,
    and lengths, counts in a document and counts of documents come from what is left."""
    shared = [c for c in on if c != "token"]
    docs = asked_only(docs, queries)
    hit = docs.select(*keys, *shared, "dl", F.explode_outer("tokens").alias("token")).where("token is not null").join(queries.select("token").distinct(), "token", "left_semi")
    tf = hit.groupBy(*keys, *shared, "dl", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    scored = tf.join(df, "token").crossJoin(F.broadcast(totals(docs))).join(queries, list(on))
    w = term_weight(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"), k1, b)
    return scored.groupBy("query_id", *keys).agg(F.sum(w * F.least(F.col("qtf"), F.lit(QUERY_MOST))).alias("score"))


def query_tokens(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(query_id, token, qtf)."""
    return postings(df.select(F.col(key).alias("query_id"), text.alias("_t")), ["query_id"], F.col("_t")).withColumnRenamed("tf", "qtf")


def _reachable(frames: Iterator[pd.DataFrame], group: str, by: list[str], ascending: list[bool], source: str, size: str, limit: int, per_source: int) -> Iterator[pd.DataFrame]:
    """Rows that a greedy choice may still take, batch by batch.

    What is left of a budget never grows, so a row skipped for its size rules out
    every later row of that size or more.  All earlier rows no larger than a row
    that is taken were therefore taken or met their source's cap: where these alone
    fill the limit, the row cannot be taken.  Counting them over a part of the rows
    only keeps more."""
    for pdf in frames:
        pdf = pdf.sort_values([group, *by], ascending=[True, *ascending], kind="stable")
        keep: list[int] = []
        held: list[tuple] = []
        now, bar = object(), float("inf")
        for at, (g, src, n) in enumerate(zip(pdf[group], pdf[source], pdf[size])):
            if g != now:
                now, held, bar = g, [], float("inf")
            if n >= bar:
                continue
            keep.append(at)
            held.append((n, src))
            held.sort(key=lambda x: x[0])
            used: dict = {}
            full, bar = 0, float("inf")
            for m, s in held:  # the least size from which on the limit is full
                used[s] = used.get(s, 0) + 1
                full += used[s] <= per_source
                if full >= limit:
                    bar = m
                    break
        yield pdf.iloc[keep]


def select_within_budget(ranked: DataFrame, group: str, order: str | Sequence[str], source: str, size: str, limit: int = 12, most: int = 14500, per_source: int = 2) -> DataFrame:
    """Greedy choice of each group (W3): by score, none at a score of 0, skip what
    exceeds the budget, at most ``per_source`` of a source, the first always.

    Each task first drops the rows that no choice can reach, so that a group brings
    some dozens of rows a batch to its task, however large it is."""
    by = ["score", *([order] if isinstance(order, str) else order)]
    ascending = [False, *[True] * (len(by) - 1)]
    cut = ranked.where(F.col("score") > 0)
    few = cut.mapInPandas(lambda frames: _reachable(frames, group, by, ascending, source, size, limit, per_source), cut.schema)
    schema = T.StructType([*cut.schema.fields, T.StructField("taken", T.IntegerType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, ascending=ascending, kind="stable")
        used: dict = {}
        chosen, total = [], 0
        for i, (src, n) in enumerate(zip(pdf[source], pdf[size])):
            if used.get(src, 0) >= per_source or chosen and total + n > most:
                continue
            chosen.append(i)
            used[src] = used.get(src, 0) + 1
            total += n
            if len(chosen) >= limit:
                break
        return pdf.iloc[chosen].assign(taken=range(1, len(chosen) + 1))

    return few.groupBy(group).applyInPandas(pick, schema)


def claim_postings(passages: DataFrame, passage: str, text: Column, claims: DataFrame) -> DataFrame:
    """(passage, dl, token, tf) of the claims' tokens only, written once: candidates and
    scores read it several times."""
    from ..session import kept

    hit = asked_only(arrays(passages, [passage], text), claims).select(passage, "dl", F.explode_outer("tokens").alias("token")).where("token is not null")
    own = hit.join(claims.select("token").distinct(), "token", "left_semi")
    return kept(own.groupBy(passage, "dl", "token").agg(F.count("*").alias("tf")), "claim-postings")


def candidates(claims: DataFrame, posts: DataFrame, passage: str, k: int = 60) -> DataFrame:
    """(claim, passage, shared, rn): passages by shared distinct tokens.

    All postings count: the reference leaves out tokens in more than 2,000 passages
    of one article's topic, but the passages here are those of all topics, so that a
    count over them would depend on the table's size.  The claims' tokens are few and
    go to the postings, so a frequent token is no hot key of a join."""
    asked = F.broadcast(claims.select("query_id", "token"))
    shared = posts.select("token", passage).join(asked, "token").groupBy("query_id", passage).agg(F.count("*").alias("shared"))
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), passage)
    return shared.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def lexical_scores(claims: DataFrame, posts: DataFrame, passage: str, pairs: DataFrame) -> DataFrame:
    """(claim, passage, score) of candidate ``pairs`` (F13); ``posts`` as of claim_postings."""
    size = claims.groupBy("query_id").agg(F.count("*").alias("q"))
    length = posts.groupBy(passage).agg(F.max("dl").alias("dl"))
    both = pairs.select("query_id", passage).join(claims, "query_id").join(posts.drop("dl"), [passage, "token"])
    s = both.groupBy("query_id", passage).agg(F.sum(F.least("qtf", "tf")).alias("overlap"), F.count("*").alias("u"))
    s = s.join(size, "query_id").join(length, passage)
    return s.select("query_id", passage, (F.col("overlap") + 4.0 * F.col("u") / F.col("q") + 2.0 * F.col("u") / F.sqrt(F.col("dl").cast("double"))).alias("score"))


def best_passage(scores: DataFrame, passage: str) -> DataFrame:
    """(claim, passage, score): the best, the least passage of ties."""
    best = scores.groupBy("query_id").agg(F.max_by(F.struct(passage, "score"), F.struct(F.col("score"), -F.col(passage))).alias("b"))
    return best.select("query_id", F.col(f"b.{passage}").alias(passage), F.col("b.score").alias("score"))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(``key``, chunk_id, chunk) by fixed stride."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step) - 1).cast("int"))
    return df.where(F.length(text) > 0).select(key, F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))).alias("chunk_id", "chunk"))


def packed_paragraphs(df: DataFrame, key: str, text: str, target: int = 900, least: int = 30, least_slice: int = 80) -> DataFrame:
    """(``key``, chunk_id, chunk): paragraphs packed to about ``target`` signs (W13);
    one over twice that is sliced without flushing the open chunk, whose slices so
    stand before it.  A fold in the JVM, no Python."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?m)\n\s*\n|(?=^#{1,4}\s)"), normalize), lambda p: F.length(p) >= least)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p)
        flush = (acc["size"] > 0) & (acc["size"] + n > target)
        done = F.when(flush, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        open_, size = F.when(flush, F.lit("")).otherwise(acc["open"]), F.when(flush, F.lit(0)).otherwise(acc["size"])
        slices = F.filter(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / target).cast("int")), lambda i: F.substring(p, i * target + 1, F.lit(target))), lambda s: F.length(s) >= least_slice)
        long = n > 2 * target
        return F.struct(F.when(long, F.concat(done, slices)).otherwise(done).alias("done"), F.when(long, open_).when(size > 0, F.concat(open_, F.lit("\n"), p)).otherwise(p).alias("open"), F.when(long, size).otherwise(size + n).cast("int").alias("size"))

    def finish(acc: Column) -> Column:
        return F.when(acc["size"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    return df.where(F.length(text) > 0).select(key, F.posexplode(F.aggregate(paragraphs, empty, step, finish)).alias("chunk_id", "chunk"))


def evidence_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """packed_paragraphs without navigation blocks and repeats: the digest of a
    chunk's word signs, first one kept (W1)."""
    chunks = packed_paragraphs(df, key, text).where(~is_boilerplate(F.col("chunk")))
    digest = F.sha1(F.regexp_replace("chunk", r"(?U)\W+", ""))
    w = Window.partitionBy(key, "digest").orderBy("chunk_id")
    return chunks.withColumn("digest", digest).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = 150, overlap: int = 50, separators: Sequence[str] = ("\n\n", "\n", "。", ". ", " ", "")) -> DataFrame:
    """(``key``, chunk_id, chunk): split at the first separator that occurs, parts
    merged up to ``size`` with ``overlap`` carried over, larger parts split further
    (W12)."""

    def cut(t: str, seps: Sequence[str]) -> list[str]:
        sep = next((s for s in seps if s and s in t), "")
        parts = [p + sep for p in t.split(sep)[:-1]] + [t.split(sep)[-1]] if sep else [t[i : i + size] for i in range(0, len(t), size)]
        rest = seps[seps.index(sep) + 1 :] if sep in seps else ()
        out: list[str] = []
        held: list[str] = []
        for p in parts:
            if len(p) > size:
                if held:
                    out.append("".join(held))
                    held = []
                out += cut(p, rest)
                continue
            if held and sum(map(len, held)) + len(p) > size:
                out.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        return out + (["".join(held)] if held else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, c) for k, t in zip(pdf["k"], pdf["t"]) for i, c in enumerate(x.strip() for x in cut(t, list(separators))) if c]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, chunk_id int, chunk string")


def overlapping_windows(n: int, width: int = 510, keep: int = 255) -> list[tuple[int, int]]:
    """Token windows that share ``keep`` tokens."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + width)))
        if at + width >= n:
            return out
        at += width - keep
