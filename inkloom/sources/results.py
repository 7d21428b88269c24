"""Score files, earlier results, reports and places of inputs (survey H7-H10, J18, K1, K3, K5, S6, S7, S12, S16-S18, W19)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCORES = "documents array<struct<topic: string, scores: map<string, double>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system of the session."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_of(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first of several places that exists (S6, S7, S17); an error names them all."""
    for c in candidates:
        if _exists(spark, c):
            return c
    raise FileNotFoundError(f"none of {list(candidates)}")


def source_folder(spark: SparkSession, root: str, topic: str, alias: str) -> str:
    """Where a topic's sources lie: a folder of its alias, or one text file."""
    return first_of(spark, [f"{root}/{alias}_sources", f"{root}/{topic}_{alias}/sources", f"{root}/{alias}/sources", f"{root}/{alias}.txt"])


def outline_file(spark: SparkSession, root: str, topic: str) -> str:
    """Where a topic's outline lies, in any of three layouts."""
    return first_of(spark, [f"{root}/{topic}/outline.md", f"{root}/{topic}_outline.md", f"{root}/outlines/{topic}.md"])


def page_files(spark: SparkSession, folder: str, generated: Sequence[str] = ("toc", "candidates", "outline")) -> DataFrame:
    """(folder, file, text) of a tree of Markdown pages without the files that later
    steps put there (S12)."""
    t = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.regexp_replace(F.input_file_name(), r"^.*?/(?=[^/]+/[^/]+$)", "")
    named = t.select(F.split(path, "/")[0].alias("folder"), F.split(path, "/")[1].alias("file"), F.col("value").alias("text"))
    return named.where(~F.lower("file").rlike("^(" + "|".join(generated) + r")\b"))


def selected(df: DataFrame, key: str, wanted: DataFrame | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of the wanted keys, or ``most`` keys in a seeded order (S16, W19).  A wanted
    key that is missing is an error."""
    if wanted is not None:
        asked = wanted.select(F.col(wanted.columns[0]).alias(key)).distinct()
        if lost := asked.join(df, key, "left_anti").limit(5).collect():
            raise LookupError(f"missing: {[r[0] for r in lost]}")
        return df.join(asked, key, "left_semi")
    if most is None:
        return df
    keys = df.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)
    return df.join(keys, key, "left_semi")


def unified_scores(spark: SparkSession, candidates: Sequence[str], method: str) -> DataFrame:
    """(method, topic, metric, score) of the first score file that exists."""
    t = spark.read.schema(SCORES).option("multiLine", True).json(first_of(spark, candidates))
    return t.select(F.explode("documents").alias("d")).select(F.lit(method).alias("method"), F.col("d.topic").alias("topic"), F.explode("d.scores").alias("metric", "score"))


def legacy_scores(spark: SparkSession, paths: dict[str, str], method: str) -> DataFrame:
    """(method, topic, metric, score) of a method's files, one per group of metrics,
    which must hold the same topics (S18, J18)."""
    files = {g: spark.read.schema(SCORES).option("multiLine", True).json(p).select(F.explode("documents").alias("d")).select("d.*") for g, p in paths.items()}
    one = equal_keys(files, "topic")
    each = [one.select("topic", F.explode(f"{g}_scores").alias("metric", "score")) for g in files]
    return reduce(DataFrame.unionByName, each).select(F.lit(method).alias("method"), "topic", "metric", "score")


def equal_keys(groups: dict[str, DataFrame], key: str) -> DataFrame:
    """Tables joined by a key that each must hold exactly once, their other columns
    prefixed by their name; a key that some lack or that is doubled raises (J18)."""
    named = []
    for g, df in groups.items():
        own = df.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(f"{g}_{c}") for c in df.columns if c != key))
        named.append(own.withColumn(f"_{g}", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"doubled in {g}: "), F.col(key).cast("string")))).otherwise(True).cast("boolean")).drop("_n"))
    joined = reduce(lambda a, b: a.join(b, key, "full"), named)
    whole = reduce(lambda a, b: a & b, (F.col(f"_{g}").isNotNull() for g in groups))
    checked = joined.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("not in every group: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")))
    return checked.drop(*(f"_{g}" for g in groups))


def prior_results(df: DataFrame, value: str, schema: str, key: str, order: str) -> DataFrame:
    """Latest readable record of each key; lines that are no JSON are passed over (H8)."""
    parsed = df.select(order, F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", order).alias("r")).select("r.*")


def variant(text: str) -> tuple[str, str]:
    """(label, path) of ``LABEL=PATH``; only the first = parts (H9)."""
    label, found, path = text.partition("=")
    if not found or not label or not path:
        raise ValueError(f"expected LABEL=PATH, not {text!r}")
    return label, path


def all_methods(spark: SparkSession, variants: Sequence[str]) -> DataFrame:
    """Scores of several methods given as LABEL=PATH (H9)."""
    return reduce(DataFrame.unionByName, (unified_scores(spark, [p], m) for m, p in map(variant, variants)))


def document_means(scores: DataFrame, keys: Sequence[str], metric: str, value: str) -> DataFrame:
    """(keys, metric, mean) with 'overall' over the metrics' means; missing values and
    metrics are passed over (H10)."""
    per = scores.where(F.col(value).isNotNull()).groupBy(*keys, metric).agg(F.avg(value).alias("mean"))
    return per.unionByName(per.groupBy(*keys).agg(F.avg("mean").alias("mean")).select(*keys, F.lit("overall").alias(metric), "mean"))


def report_domain(topics: DataFrame, registry: DataFrame, key: str = "domain") -> DataFrame:
    """Topics with the settings of their domain; ``route`` is 'generic' where the
    registry does not know it (H7)."""
    own = registry.withColumn("_known", F.lit(True))
    return topics.join(own, key, "left").withColumn("route", F.when(F.col("_known"), F.col(key)).otherwise("generic")).drop("_known")


def collection_report(pages: DataFrame, key: str, order: str) -> DataFrame:
    """(``key``, report, corpus) of fetched pages (title, source, url, body): numbered
    articles with their head, and the bodies alone, one a line (K1)."""
    g = pages.where(F.length("body") > 0).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "source", "url", "body"))))).alias("p"))
    block = lambda p, i: F.concat(F.lit("[文章 "), (i + 1).cast("string"), F.lit("] "), p["title"], F.lit(" ["), p["source"], F.lit("]\nURL: "), p["url"], F.lit("\n正文：\n"), p["body"])
    return g.select(key, F.array_join(F.transform("p", block), "\n\n").alias("report"), F.array_join(F.transform("p", lambda p: F.regexp_replace(p["body"], r"\s*\n\s*", " ")), "\n").alias("corpus"))


def match_lines(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """(topic, sent_id, line) of ``evidence.match_items`` rows: the sentence with its
    status, and the sentence found instead on a second line (K3)."""
    own = corpus.select("sent_id", "sentence")
    other = corpus.select(F.col("sent_id").alias("fallback_id"), F.col("sentence").alias("_other"))
    j = items.join(own, "sent_id", "left").join(other, "fallback_id", "left")
    first = F.concat(F.lit("[sent_id="), F.col("sent_id").cast("string"), F.lit("] ["), F.col("status"), F.lit("] "), F.coalesce("sentence", F.lit("")))
    second = F.concat(F.lit("\n  -> [sent_id="), F.col("fallback_id").cast("string"), F.lit("] "), F.coalesce("_other", F.lit("")))
    return j.select("topic", "sent_id", F.when(F.col("fallback_id").isNull(), first).otherwise(F.concat(first, second)).alias("line"))


def reference_text(snippet: Column, body: Column, least: int = 60) -> Column:
    """What a reference list holds of a source: its snippet if long enough, else its
    whole body (K5)."""
    return F.when(F.length(snippet) >= least, snippet).otherwise(F.coalesce(body, F.lit("")))
