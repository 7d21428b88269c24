"""The pN_ queries of this subpackage, over whole tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import boilerplate, clusters, lookalike, mojibake, packing, sentences, site_lines, splitting, templates, tokenizing
from .common import shared_dir, table, written


def _tuple_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(clusters.groups(table(spark, sf_dir, "feature_bank", "tuple_id", *clusters.VIEWS)), "groups")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _tuple_groups(spark, sf_dir).where("group_id is not null").select("tuple_id", "group_id")
    pairs = table(spark, sf_dir, "judged_pairs", "left_id", "right_id").select(F.least("left_id", "right_id").alias("tuple_a"), F.greatest("left_id", "right_id").alias("tuple_b")).where("tuple_a < tuple_b").distinct()
    a = inside.select(F.col("tuple_id").alias("tuple_a"), F.col("group_id").alias("ga"))
    b = inside.select(F.col("tuple_id").alias("tuple_b"), F.col("group_id").alias("gb"))
    return pairs.join(a, "tuple_a").join(b, "tuple_b").where("ga = gb").select("tuple_a", "tuple_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's size and most typical tuples."""
    return clusters.described(_tuple_groups(spark, sf_dir))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each tuple, null for tuples that resemble nothing."""
    return _tuple_groups(spark, sf_dir).select("tuple_id", "group_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.found_ids(table(spark, sf_dir, "search_results", "id", "content"))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_results`` without the records of p2_found."""
    rows = table(spark, sf_dir, "search_results")
    return rows.join(templates.found_ids(rows.select("id", "content")), "id", "left_anti").select("id", "topic_id", "title", "url", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, sf_dir, "source_documents", "ref_id", "url", "body"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "source_documents", "ref_id", "url", "body")
    return site_lines.without_lines(docs, site_lines.repeated_lines(docs)).select("ref_id", F.col("clean").alias("body")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_ids(table(spark, sf_dir, "search_results", "id", "content"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(table(spark, sf_dir, "search_results", "id", "content")).distinct()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the three fields with their limit in characters."""
    body = table(spark, sf_dir, "source_documents", "ref_id", "body").select(F.lit("SourceDocument.body").alias("field"), F.col("ref_id").cast("long").alias("rec_id"), F.lit(-1).alias("chunk_id"), F.col("body").alias("text"))
    chunk = table(spark, sf_dir, "evidence_chunks", "ref_id", "chunk_id", "text").select(F.lit("EvidenceChunk.text").alias("field"), F.col("ref_id").cast("long").alias("rec_id"), F.col("chunk_id").cast("int"), "text")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.lit("Document.text").alias("field"), F.col("doc_id").alias("rec_id"), F.lit(-1).alias("chunk_id"), "text")
    limits: dict[str, set] = {}
    for r in table(spark, sf_dir, "size_limits").where("unit = 'char' and max_size > 0").collect():  # a fixed handful of rows
        limits.setdefault(r.field, set()).add((r.max_size, r.overlap or 0))
    parts = []
    for f, df in (("SourceDocument.body", body), ("EvidenceChunk.text", chunk), ("Document.text", docs)):
        own = F.array(*(F.struct(F.lit(n).alias("max_size"), F.lit(o).alias("overlap")) for n, o in sorted(limits.get(f, ()))))
        if f in limits:
            parts.append(df.select("*", F.explode(F.filter(own, lambda x: F.length("text") > x["max_size"])).alias("l")).select(*df.columns, "l.*"))
    if not parts:
        return body.withColumns({"max_size": F.lit(0), "overlap": F.lit(0)}).where("false")
    return functools.reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.ranges(splitting.oversized(_items(spark, sf_dir)))
    return splitting.pieces(cut).where("piece = 0").select("field", "rec_id", "chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = written(splitting.ranges(splitting.oversized(_items(spark, sf_dir))), "ranges")
    out = splitting.piece_texts(cut, splitting.pieces(cut))
    return out.select("field", "rec_id", "chunk_id", "max_size", "piece", "start", "end", "text")


def p5_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` as a few large files in the shared folder, cut by byte
    ranges without loading any whole; the limit is that of ``Document.text``."""
    limit = table(spark, sf_dir, "size_limits").where("unit = 'char' and field = 'Document.text' and max_size > 0").agg(F.max("max_size"), F.max_by("overlap", "max_size")).first()
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents", "text").where("text is not null").select(F.col("text").alias("value")).write.text(path)
    cut = written(splitting.file_ranges(spark, path, limit[0] or splitting.RANGE, limit[1] or 0), "file-ranges")
    return splitting.piece_texts(cut, splitting.pieces(cut)).select(F.col("rec_id").alias("file"), "piece", "start", "end", "text")


def _pages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both tables of pages as (k, title, t), each row once, without the records of
    p2_found."""
    results = table(spark, sf_dir, "search_results", "id", "title", "content")
    failed = templates.found_ids(results.select("id", "content"))
    results = results.join(failed, "id", "left_anti").select(F.col("id").cast("long").alias("k"), "title", F.col("content").alias("t"))
    docs = table(spark, sf_dir, "source_documents", "ref_id", "title", "body").select(F.col("ref_id").cast("long").alias("k"), "title", F.col("body").alias("t"))
    return {"search_results": results, "source_documents": docs}


def _page_model(spark: SparkSession, sf_dir: str) -> boilerplate.Model:
    results = table(spark, sf_dir, "search_results", "id", "title", "content", "url").select(F.col("id").cast("long").alias("k"), "title", F.col("content").alias("t"), "url")
    docs = table(spark, sf_dir, "source_documents", "ref_id", "title", "body", "url").select(F.col("ref_id").cast("long").alias("k"), "title", F.col("body").alias("t"), "url")
    return boilerplate.fit([results, docs])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _page_model(spark, sf_dir)
    parts = [boilerplate.chrome_lines(df, model).select(F.lit(name).alias("tbl"), F.col("k").alias("rec_id"), "line_no") for name, df in _pages(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).distinct()


def p6_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _page_model(spark, sf_dir)
    parts = [boilerplate.main_text(df, model).select(F.lit(name).alias("tbl"), F.col("k").alias("rec_id"), F.col("main").alias("text")) for name, df in _pages(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1]).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "source_documents", "ref_id", "body")).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits").where("unit = 'token' and field = 'documents.text'").select("max_size").distinct().collect()
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), [r.max_size for r in limits])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose look has several spellings, with their class: p10_found folded."""
    return lookalike.lookalike_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "canonical")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return {name: sql for name, sql in SQL.items() if name in queries()}
