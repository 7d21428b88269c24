"""Citations bound to passages, and what is told of an article (survey A27, A34, H1, H2, H4, H6, J27, P18).

Segments and passages meet over shared tokens; a passage is scored as in
``retrieval.lexical_scores``.  The choice of a passage is a ``min_by`` over the
candidates of a segment, so no segment's candidates are gathered.  Where a whole scope
meets, its pairs grow with its square and are scored block by block in the tasks, which
give out the best of a block only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import citations
from .evidence import words
from .text import numeric_values

#: Words that make a segment a factual one.
FACTUAL = r"达到|提升|降低|支持|采用|包括|实现|标准|要求|根据|显示|表明|应当|必须"
#: Least scores of a passage for a numeric and for another segment.
NUMERIC, PLAIN, SHORTEST = 4.0, 8.0, 24
#: What a passage of another source must score at least, and more than one of the cited source.
OTHER, MORE = 4.0, 1
#: Segments' tokens, some bytes each, that go to all tasks, up to which the passages' other tokens are cut before they are written.
VOCABULARY = 1 << 20
#: Passages and segments of a scope that meet in one task, at about.
BLOCK = 1 << 14
#: Far more than the rounding of a score and of the sums behind it.
NEAR = 1e-6


def _score(u: Column, n: Column, m: Column) -> Column:
    """Of ``u`` shared tokens of ``n`` of a segment and ``m`` of a passage."""
    return F.round(u + 4.0 * u / n + 2.0 * u / F.sqrt(m.cast("double")), 9)


def passage_scores(segments: DataFrame, passages: DataFrame, within: Sequence[str]) -> DataFrame:
    """(seg, pid, score) of ``segments`` (seg, text) and ``passages`` (pid, text) that
    share a token and the columns ``within``: a source, or an article's or a topic's
    passages, which bound the pairs that meet."""
    asked = segments.select("seg", *within, words(F.col("text")).alias("q")).select("seg", *within, F.size("q").alias("n"), F.explode("q").alias("token"))
    held = passages.select("pid", *within, words(F.col("text")).alias("w")).select("pid", *within, F.size("w").alias("m"), F.explode("w").alias("token"))
    s = asked.join(held, [*within, "token"]).groupBy("seg", "pid").agg(F.count("*").alias("u"), F.first("n").alias("n"), F.first("m").alias("m"))
    return s.select("seg", "pid", _score(F.col("u"), F.col("n"), F.col("m")).alias("score"))


def _squeezed(c: Column) -> Column:
    """A text as its numbers are looked for."""
    return F.translate(F.lower(F.regexp_replace(c, r"\s+", "")), "％～—", "%~-")


def has_numbers(segment: Column, passage: Column) -> Column:
    """Whether ``passage`` has every number of ``segment``; true where it has none."""
    plain = _squeezed(passage)
    return F.forall(numeric_values(segment), lambda n: F.contains(plain, n))


def _best(scored: DataFrame, segments: DataFrame, passages: DataFrame) -> DataFrame:
    """(seg, best): of the passages that tell a segment's numbers the one of best score,
    the least of equals."""
    full = scored.join(segments.select("seg", F.col("text").alias("_t")), "seg").join(passages.select("pid", "ref", F.col("text").alias("_p")), "pid").where(has_numbers(F.col("_t"), F.col("_p")))
    return full.groupBy("seg").agg(F.max_by(F.struct("pid", "ref", "score"), F.struct(F.col("score"), -F.col("pid"))).alias("b"))


def _held(passages: DataFrame, scope: str, segments: DataFrame) -> DataFrame:
    """``passages`` (pid, ref, text, ``scope``) as (pid, ref, ``scope``, length, digest, m, w,
    plain), written once: the number of their tokens, those that ``segments`` (q, numbers)
    have, of all where these are many, and the text for numbers if a segment has any."""
    from ..session import kept

    wanted = segments.select(F.explode("q").alias("t")).distinct().limit(VOCABULARY + 1).toArrow()["t"].combine_chunks()
    numeric = not segments.where(F.size("numbers") > 0).isEmpty()
    plain = _squeezed(F.col("text")) if numeric else F.lit(None).cast("string")
    told = passages.select("pid", "ref", scope, F.length("text").alias("length"), F.left(F.sha1("text"), F.lit(16)).alias("digest"), words(F.col("text")).alias("w"), plain.alias("plain"))
    told = told.withColumn("m", F.size("w"))
    if len(wanted) > VOCABULARY:
        return kept(told, "held-passages")

    at = told.columns.index("w")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            w = pc.split_pattern(b["w"], " ")
            own = pc.is_in(w.flatten(), value_set=wanted)
            ends = np.concatenate(([0], np.cumsum(own.to_numpy(zero_copy_only=False))))[w.offsets.to_numpy()]
            yield b.set_column(at, "w", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), w.flatten().filter(own)))

    return kept(told.withColumn("w", F.array_join("w", " ")).mapInArrow(run, told.schema), "held-passages")


def _meet(asked: pa.Table, held: pa.Table, scope: str, least: float, out: pa.Schema) -> pa.Table:
    """Of a block's passages those that may be the best of a segment: all within NEAR of
    the best that has its numbers, of equal counts the least; none below ``least``."""
    if not asked.num_rows or not held.num_rows:
        return out.empty_table()
    held = held.sort_by("pid")
    q, w = (pc.split_pattern(t[c].combine_chunks(), " ") for t, c in ((asked, "q"), (held, "w")))
    known = pc.unique(q.flatten())
    tokens, ends = pc.index_in(q.flatten(), value_set=known).to_numpy(), np.cumsum(pc.list_value_length(q).to_numpy())
    at = pc.index_in(w.flatten(), value_set=known).fill_null(-1).to_numpy()
    order = np.argsort(at, kind="stable")
    rows = np.repeat(np.arange(len(w)), pc.list_value_length(w).to_numpy())[order]
    begin = np.searchsorted(at[order], np.arange(len(known) + 1))
    m = held["m"].to_numpy().astype(np.int64)
    share = 2.0 / np.sqrt(m)
    numbers, plain = asked["numbers"].to_pylist(), held["plain"].to_pylist() if held["plain"].null_count < held.num_rows else [None] * held.num_rows
    has = lambda i, own: plain[i] is not None and all(x in plain[i] for x in own)
    found: list[tuple[np.ndarray, ...]] = []
    for k, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
        u = np.bincount(np.concatenate([rows[begin[t] : begin[t + 1]] for t in tokens[a:b]]), minlength=len(m))
        s = u * (1 + 4.0 / (b - a) + share)
        if numbers[k]:
            by = np.flatnonzero(s >= least - NEAR)
            by = by[np.argsort(-s[by], kind="stable")]
            best = next((s[i] for i in by if has(i, numbers[k])), -1.0)
            near = np.array(sorted(i for i in by[s[by] >= best - NEAR] if s[i] <= best + NEAR and has(i, numbers[k])) if best >= 0 else [], dtype=np.int64)
        else:
            near = np.flatnonzero(s >= max(s.max(), least) - NEAR)
        near = near[np.sort(np.unique(u[near] * (m.max() + 1) + m[near], return_index=True)[1])]
        found.append((np.full(len(near), k), near, u[near], np.full(len(near), b - a)))
    k, i, u, n = (np.concatenate(x) for x in zip(*found))
    left, right = asked.take(k), held.take(i)
    return pa.table([left[scope], left["text"], right["pid"], right["ref"], right["digest"], pa.array(u), pa.array(n), right["m"]], schema=out)


def _best_of_scope(own: DataFrame, held: DataFrame, scope: str, least: float) -> DataFrame:
    """(``scope``, text, any): of a scope's passages that have a text's numbers the one of
    best score, the least of equals; none below ``least``.

    Equal texts of a scope are asked for once.  A scope of many passages or texts is cut
    into blocks, each pair of which meets in one task; only the large ones, of which there
    are at most one a BLOCK of rows, go to all tasks by their count."""
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = own.where(F.col(scope).isNotNull() & (F.size("q") > 0)).groupBy(scope, "text").agg(F.first("q").alias("q"), F.first("numbers").alias("numbers"))
    told = held.where(F.col(scope).isNotNull() & (F.size("w") > 0))
    parts = lambda df, name: F.broadcast(df.groupBy(scope).agg(F.ceil(F.count("*") / BLOCK).alias(name)).where(F.col(name) > 1))
    big = parts(told, "_parts"), parts(texts, "_shares")

    def cut(df: DataFrame, key: str, own_n: str, other_n: str) -> DataFrame:
        n, other = F.coalesce(own_n, F.lit(1)), F.coalesce(other_n, F.lit(1))
        at = F.pmod(F.xxhash64(key), n), F.explode(F.sequence(F.lit(0).cast("long"), other - 1))
        names = "_part", "_share"
        both = df.join(big[0], scope, "left").join(big[1], scope, "left")
        return both.select(*df.columns, *(x.alias(c) for x, c in zip(at, names if own_n == "_parts" else names[::-1])))

    asked = cut(texts.withColumn("q", F.array_join("q", " ")), "text", "_shares", "_parts")
    given = cut(told.select("pid", "ref", scope, "digest", "m", F.array_join("w", " ").alias("w"), "plain"), "pid", "_parts", "_shares")
    kinds = {f.name: f.dataType for f in held.schema.fields}
    out = T.StructType([T.StructField(scope, kinds[scope]), T.StructField("text", T.StringType()), *(T.StructField(c, kinds[c]) for c in ("pid", "ref", "digest")), T.StructField("u", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.IntegerType())])
    arrow = to_arrow_schema(out)
    key = [scope, "_part", "_share"]
    near = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(lambda a, h: _meet(a, h, scope, least, arrow), out)
    scored = near.withColumn("score", _score(F.col("u"), F.col("n"), F.col("m")))
    return scored.groupBy(scope, "text").agg(F.max_by(F.struct("pid", "ref", "digest", "score"), F.struct(F.col("score"), -F.col("pid"))).alias("any"))


def rebound(segments: DataFrame, passages: DataFrame, scope: str, edit: bool = True) -> DataFrame:
    """Segments (seg, ref, text, ``scope``) against passages (pid, ref, text, ``scope``), a row for each reference a segment cites, with the
    passage that the citation is bound to (H1).

    That is the best passage of the cited source that has all of the segment's numbers.
    A passage of another source takes its place only where it scores 4 at least and 1
    more.  Where none is left, the segment is dropped if it has a number and may be
    edited; else it keeps its source's longest passage.  (seg, ref, pid, bound_ref,
    anchor, dropped).  The anchor names the source, the passage and the segment."""
    from ..session import kept

    read = segments.select("seg", "ref", "text", scope, words(F.col("text")).alias("q"), numeric_values(F.col("text")).alias("numbers"))
    own = kept(read.withColumn("_seg", F.xxhash64("seg", "ref")), "cited-segments")
    held = _held(passages, scope, own)
    pairs = own.select("_seg", "ref", "q", "numbers").join(held.where(F.size("w") > 0).select("ref", "pid", "digest", "m", F.array_join("w", " ").alias("w"), "plain"), "ref")
    pairs = pairs.withColumn("u", F.size(F.array_intersect(F.split("w", " "), "q"))).where((F.col("u") > 0) & F.forall("numbers", lambda n: F.contains("plain", n)))
    scored = pairs.select("_seg", "pid", "digest", _score(F.col("u"), F.size("q"), F.col("m")).alias("score"))
    mine = scored.groupBy("_seg").agg(F.max_by(F.struct("pid", "digest", "score"), F.struct(F.col("score"), -F.col("pid"))).alias("mine"))
    longest = held.groupBy("ref").agg(F.max_by(F.struct("pid", "digest"), F.struct("length", -F.col("pid"))).alias("longest"))
    j = own.join(mine, "_seg", "left").join(_best_of_scope(own, held, scope, OTHER), [scope, "text"], "left").join(longest, "ref", "left")
    other = (F.col("any.ref") != F.col("ref")) & (F.col("any.score") >= F.greatest(F.lit(OTHER), F.coalesce("mine.score", F.lit(0.0)) + MORE))
    place = lambda c: F.struct(f"{c}.pid", f"{c}.digest")
    found = F.when(other, place("any")).when(F.col("mine").isNotNull(), place("mine"))
    dropped = found.isNull() & (F.size("numbers") > 0) & F.lit(edit)
    out = j.select("seg", "ref", "text", F.when(~dropped, F.coalesce(found, F.col("longest"))).alias("_at"), F.when(other, F.col("any.ref")).otherwise(F.col("ref")).alias("_ref"), dropped.alias("dropped"))
    bound = F.col("_at.pid").isNotNull()
    anchor = F.concat_ws(":", F.col("_ref").cast("string"), F.col("_at.digest"), F.left(F.sha1("text"), F.lit(12)))
    return out.select("seg", "ref", F.col("_at.pid").alias("pid"), F.when(bound, F.col("_ref")).alias("bound_ref"), F.when(bound, anchor).alias("anchor"), "dropped")


def grounded_segments(segments: DataFrame, passages: DataFrame, scope: str, edit: bool = True) -> DataFrame:
    """(seg, pid, bound_ref, dropped) of uncited segments (seg, text, ``scope``) (H2).

    A segment is asked for if it has a number or a factual word and is long enough.  Its
    best passage counts from a score of 4 with numbers and 8 without; with numbers and
    no such passage it is dropped.  Without ``edit`` only that is done."""
    numeric = F.size(numeric_values(F.col("text"))) > 0
    asked = segments.withColumn("_numeric", numeric).withColumn("_ask", (F.length("text") >= SHORTEST) & (numeric | F.col("text").rlike(FACTUAL)))
    few = asked.where("_ask")
    best = _best(passage_scores(few, passages, [scope]), few, passages)
    j = asked.join(best, "seg", "left")
    enough = F.coalesce(F.col("b.score") >= F.when(F.col("_numeric"), NUMERIC).otherwise(PLAIN), F.lit(False))
    use = enough if edit else F.lit(False)
    return j.select("seg", F.when(use, F.col("b.pid")).alias("pid"), F.when(use, F.col("b.ref")).alias("bound_ref"), (F.col("_ask") & F.col("_numeric") & ~enough).alias("dropped"))


def first_use_ids(bound: DataFrame, doc: str, order: str, anchor: str = "anchor") -> DataFrame:
    """(doc, anchor, new_id): anchors numbered from 1 by first use in their document (H1)."""
    first = bound.where(F.col(anchor).isNotNull()).groupBy(doc, anchor).agg(F.min(order).alias("_at"))
    return first.select(doc, anchor, F.row_number().over(Window.partitionBy(doc).orderBy("_at", anchor)).alias("new_id"))


def by_source(bound: DataFrame, passages: DataFrame, most: int = 900) -> DataFrame:
    """(ref, pid, claims, text) of ``bound`` (seg, pid, bound_ref): one reference a
    source.  Its anchor is the passage with most claims, the least of equals; its text
    the distinct passages, the anchor's first, as far as they fit ``most`` (A34).

    ``bound`` is one article's or carries the article in ``seg``; a source's passages
    in it are few, and are folded in the JVM."""
    per = bound.where("pid is not null").groupBy("bound_ref", "pid").agg(F.count_distinct("seg").alias("n"))
    whole = per.join(passages.select("pid", "text"), "pid").groupBy("bound_ref").agg(F.sum("n").alias("claims"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "pid", "text"))).alias("all"))

    def pack(acc: Column, x: Column) -> Column:
        skip = F.array_contains(acc["out"], x["text"]) | ((F.size(acc["out"]) > 0) & (acc["used"] + 1 + F.length(x["text"]) > most))
        return F.struct(F.when(skip, acc["out"]).otherwise(F.array_append(acc["out"], x["text"])).alias("out"), F.when(skip, acc["used"]).otherwise(acc["used"] + F.length(x["text"]) + (F.size(acc["out"]) > 0).cast("int")).alias("used"))

    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))
    return whole.select(F.col("bound_ref").alias("ref"), F.get(F.col("all"), F.lit(0))["pid"].alias("pid"), "claims", F.left(F.array_join(F.aggregate("all", empty, pack)["out"], "\n"), F.lit(most)).alias("text"))


def package(docs: DataFrame, key: str, text: str, references: DataFrame, ref: str) -> DataFrame:
    """(``key``, chars, total, uniq, dominant, ratio, paragraphs, sentences, n_invalid,
    json): what an evaluation is told of an article's evidence (A27).  Documents without
    a citation have zeros."""
    base = docs.select(key, F.length(text).alias("chars"))
    bad = citations.invalid(docs, key, text, references, ref).groupBy(key).agg(F.count("*").alias("n_invalid"))
    out = base.join(citations.distribution(docs, key, text), key, "left")
    out = out.join(citations.paragraph_coverage(docs, key, text).withColumnRenamed("coverage", "paragraphs"), key, "left")
    out = out.join(citations.sentence_coverage(docs, key, text).withColumnRenamed("coverage", "sentences"), key, "left").join(bad, key, "left")
    out = out.fillna(0, ["total", "uniq", "n_invalid"]).fillna(0.0, ["ratio", "paragraphs", "sentences"])
    return out.withColumn("json", F.to_json(F.struct(*[c for c in out.columns if c != key])))


def real_ids(placeholders: Column, known: Column) -> Column:
    """Sorted distinct ids that an array of placeholder numbers, each with an array of
    ids in the map ``known``, stands for; unknown ones go (J27)."""
    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(placeholders, lambda p: F.try_element_at(known, p)), lambda x: x.isNotNull()))))


def resolved_ids(df: DataFrame, key: str, placeholders: str, known: DataFrame) -> DataFrame:
    """(``key``, refs) of rows with an array of placeholder numbers against a table
    ``known`` (placeholder, ids): sorted distinct ids, an empty array where none is
    known (J27 for any number of placeholders)."""
    each = df.select(key, F.explode(F.array_distinct(placeholders)).alias("placeholder")).join(known, "placeholder")
    refs = each.select(key, F.explode("ids").alias("id")).groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("refs"))
    return df.select(key).distinct().join(refs, key, "left").withColumn("refs", F.coalesce("refs", F.array().cast(refs.schema["refs"].dataType)))


def headings(outline: Column) -> Column:
    """A numbered outline as Markdown headings: ``1 a`` is of level 1, ``1.2 b`` of
    level 2, ``1.2.3 c`` of level 3; lines that are headings already stay (H4)."""
    s = F.regexp_replace(outline, r"(?m)^[ \t]*\d+\.\d+\.\d+[.、]?[ \t]+(?=\S)", "### ")
    s = F.regexp_replace(s, r"(?m)^[ \t]*\d+\.\d+[.、]?[ \t]+(?=\S)", "## ")
    return F.regexp_replace(s, r"(?m)^[ \t]*\d+[.、]?[ \t]+(?=\S)", "# ")


def outline_form(outline: Column) -> Column:
    """Whether an outline's lines are 'headings', 'numbered' or 'plain' (H4)."""
    return F.when(outline.rlike(r"(?m)^#{1,6} "), "headings").when(outline.rlike(r"(?m)^[ \t]*\d+(\.\d+)*[.、]?[ \t]+\S"), "numbered").otherwise("plain")


def without_appendix(outline: DataFrame, title: str, marks: tuple[str, ...] = ("附录", "参考文献")) -> DataFrame:
    """Roots that are no appendix."""
    for m in marks:
        outline = outline.where(~F.contains(F.coalesce(title, F.lit("")), F.lit(m)))
    return outline


def bounded(c: Column, head: int, tail: int = 0, mark: str = "…") -> Column:
    """Head and tail of a field, as a prompt's state has it; short ones stay (H6)."""
    cut = F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(tail))) if tail else F.left(c, F.lit(head))
    return F.when(F.length(c) <= head + tail, c).otherwise(cut)
