"""Citation and claim checks (survey A25, A26, F10, F12, F19, J14, J15, P17, P20, P21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import citation_ids, numeric_values

MARK = r"\[\^\d+\]"


def distribution(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, total, uniq, dominant, ratio): citations of each text; the first of
    equally frequent ids is dominant (A25)."""
    ids = df.select(key, F.posexplode(citation_ids(F.col(text))).alias("_pos", "_cited"))
    per = ids.groupBy(key, "_cited").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    return per.groupBy(key).agg(F.sum("_n").alias("total"), F.count("*").alias("uniq"), F.max_by("_cited", F.struct(F.col("_n"), -F.col("_first"))).alias("dominant"), (F.max("_n") / F.sum("_n")).alias("ratio"))


def paragraph_coverage(df: DataFrame, key: str, text: str, least: int = 45) -> DataFrame:
    """(``key``, coverage): share of paragraphs with a citation; headings, tables and
    short ones do not count, none gives 0 (A26)."""
    lines = F.transform(F.split(F.col("block"), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    joined = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), " ")
    blocks = df.select(key, F.explode(F.split(text, r"\n\s*\n")).alias("block")).select(key, joined.alias("p"))
    kept = blocks.where((F.col("p") != "") & ~F.col("p").startswith("|")).where(F.length(F.regexp_replace("p", MARK, "")) >= least)
    got = kept.groupBy(key).agg(F.avg(F.col("p").rlike(MARK).cast("double")).alias("coverage"))
    return df.select(key).distinct().join(got, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def sentence_coverage(df: DataFrame, key: str, text: str, least: int = 12) -> DataFrame:
    """(``key``, coverage): the same of factual sentences."""
    plain = F.regexp_replace(text, r"(?m)^#{1,4}\s.*$", "")
    parts = df.select(key, F.explode(F.split(plain, r"(?<=[。！？])")).alias("s")).withColumn("s", F.regexp_replace("s", r"(?U)^\s+|\s+$", "")).where("s <> ''")
    bare = F.regexp_replace("s", MARK, "")
    listed = bare.rlike(r"^(\||-|[1-5]\.)") & (F.length(bare) < 30)
    kept = parts.where((F.length(F.regexp_replace(bare, r"[\s*`#|]", "")) >= least) & ~listed)
    got = kept.groupBy(key).agg(F.avg(F.col("s").rlike(MARK).cast("double")).alias("coverage"))
    return df.select(key).distinct().join(got, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def invalid(df: DataFrame, key: str, text: str, references: DataFrame, ref: str) -> DataFrame:
    """(``key``, cited) of citations without a reference."""
    ids = df.select(key, F.explode(F.array_distinct(citation_ids(F.col(text)))).alias("cited"))
    return ids.join(references.select(F.col(ref).alias("cited")), "cited", "left_anti")


def unsupported_numbers(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, value) of ``claims`` (claim_id, ref, text) whose number none of the
    cited ``evidence`` (ref, text) has (J15, F10)."""
    said = claims.select("claim_id", "ref", F.explode(numeric_values(F.col("text"))).alias("value"))
    squeezed = F.translate(F.lower(F.regexp_replace("text", r"\s+", "")), "％～—", "%~-")
    found = said.join(evidence.select("ref", squeezed.alias("e")), "ref").where(F.contains("e", "value")).select("claim_id", "value").distinct()
    return said.select("claim_id", "value").distinct().join(found, ["claim_id", "value"], "left_anti")


def gate(length: Column, paragraphs: Column, sentences: Column, unique: Column, allowed: Column, ratio: Column, problems: Column) -> Column:
    """Whether a section is accepted (P20)."""
    return (length >= 1450) & (paragraphs >= 0.72) & (sentences >= 0.88) & (unique >= F.least(F.lit(5), allowed)) & (ratio <= 0.5) & (problems == 0)


def quality(length: Column, coverage: Column, unique: Column, required: Column, dominant: Column, hard: Column, audit: Column) -> Column:
    """Score of a section."""
    s = 3 * F.least(length, F.lit(1600)) / 1600 + 2 * F.least(coverage, F.lit(0.95)) / 0.95 + F.least(unique / F.greatest(required, F.lit(1)), F.lit(1.0))
    s = s + F.greatest(F.lit(0.0), 1 - dominant) - 0.55 * hard - 0.12 * F.least(F.lit(10), audit)
    return s - F.when(length < 950, 6).otherwise(0)


def drift_ok(before: Column, after: Column, low: float = 0.82, high: float = 1.08, subset: bool = False) -> Column:
    """Whether an edit kept citations and length."""
    a, b = F.array_distinct(citation_ids(before)), F.array_distinct(citation_ids(after))
    same = F.size(F.array_except(b, a)) == 0
    if not subset:
        same = same & (F.size(F.array_except(a, b)) == 0)
    return same & (F.length(after) / F.length(before)).between(low, high)
