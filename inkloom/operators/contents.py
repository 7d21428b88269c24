"""Tables of contents (survey P10-P13, F3, F5, H11, H12, J21, K4)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F


def candidate_lines(files: DataFrame) -> DataFrame:
    """(folder, file_idx, pos, line) of ``files`` (folder, file_idx, text): lines with a
    digit and a letter, out of the first file that says 目录 and the next three, or of
    all files where none does; a folder's repeated lines once (P10, P11, W1)."""
    marked = files.withColumn("_at", F.min(F.when(F.contains("text", F.lit("目录")), F.col("file_idx"))).over(Window.partitionBy("folder")))
    picked = marked.where("_at is null or file_idx between _at and _at + 3")
    lines = picked.select("folder", "file_idx", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    lines = lines.where(F.col("line").rlike(r"[0-9]") & F.col("line").rlike(r"[A-Za-z\x{4e00}-\x{9fff}]"))
    w = Window.partitionBy("folder", "line").orderBy("file_idx", "pos")
    return lines.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("folder", "file_idx", "pos", "line")


def clean(title: Column) -> Column:
    """Title without its numbering."""
    s = F.regexp_replace(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""), r"^\d+(\.\d+)*[\s.、]+", "")
    s = F.regexp_replace(s, r"^[一二三四五六七八九十百]+[、.\s]+", "")
    return F.trim(F.regexp_replace(s, r"^[(（][一二三四五六七八九十\d]+[)）]\s*", ""))


def two_levels(text: Column) -> Column:
    """X.Y.Z headings as X.Y."""
    return F.regexp_replace(text, r"(?m)^(\s*\d+\.\d+)(\.\d+)+", "$1")


def rows(files: DataFrame, header: int = 3) -> DataFrame:
    """(doc_id, level, seq, title, parent_l1) of ``files`` (doc_id, text): an indented
    line is of level 2, blank lines and runs of # are skipped, so are ``header``
    lines (P13, J21, H12)."""
    lines = files.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).where(F.col("pos") >= header)
    lines = lines.where(~F.col("line").rlike(r"^\s*#*\s*$"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    level = F.when(F.col("line").rlike(r"^[ \t]"), 2).otherwise(1)
    titled = lines.select("doc_id", level.alias("level"), F.row_number().over(w).alias("seq"), clean(F.col("line")).alias("title")).where("title <> ''")
    first = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return titled.withColumn("parent_l1", F.when(F.col("level") == 2, first))


def check(text: str) -> tuple[bool, str]:
    """Whether a rebuilt table of contents has the wanted structure, and the first
    line that has not (P12)."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return False, "empty"
    for x in lines:
        if not re.match(r"^\s*(?:\d+(?:\.\d+)?[.、\s]|[一二三四五六七八九十]+、|附录|参考文献|前言|#)", x):
            return False, x.strip()
    return (True, "") if any(re.match(r"^\S", x) for x in lines) else (False, "no first level")


def verdict(reply: str) -> int:
    """Keep (1) or delete (2): the last line that is one of them, else keep."""
    return next((int(x) for x in reversed([y.strip() for y in reply.splitlines()]) if x in ("1", "2")), 1)


def renumbered(parts: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``parts`` (group, order…, level, title) of several outlines as one, numbered
    through: level 1 by its place in the group, level 2 within its first level, deeper
    ones not (K4)."""
    w = Window.partitionBy(group).orderBy(*order)
    top = F.count_if(F.col("level") == 1).over(w)
    second = F.count_if(F.col("level") == 2).over(Window.partitionBy(group, "_top").orderBy(*order))
    out = parts.withColumn("_top", top)
    number = F.when(F.col("level") == 1, F.col("_top").cast("string")).when(F.col("level") == 2, F.concat_ws(".", F.col("_top").cast("string"), second.cast("string")))
    return out.withColumn("number", number).drop("_top")
