"""Readers of the corpus' files (survey S1-S5, S8-S11, S13, S19-S22, K2, K5-K8, H21).

Every reader gives a DataFrame with an explicit schema; files are read by
executors, never by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|\s+$", "")


def topic_lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(topic) of a list file; blank lines go, and lines with # if ``comments``."""
    t = spark.read.text(path).select(_strip(F.col("value")).alias("topic")).where("topic <> ''")
    return t.where(~F.col("topic").startswith("#")) if comments else t


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, sent_id, sentence): non-blank lines, ids dense from 0 in each file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    kept = whole.withColumn("sentence", _strip(F.col("line"))).where("sentence <> ''")
    return kept.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1).alias("sent_id"), "sentence")


def parity(corpus: DataFrame, info: DataFrame) -> DataFrame:
    """(sent_id, problem) where two tables of sentences differ (S3)."""
    a, b = corpus.select("sent_id", F.col("sentence").alias("a")), info.select("sent_id", F.col("sentence").alias("b"))
    j = a.join(b, "sent_id", "full")
    problem = F.when(F.col("a").isNull(), "only in info").when(F.col("b").isNull(), "only in corpus").when(F.col("a") != F.col("b"), "differs")
    return j.select("sent_id", problem.alias("problem")).where("problem is not null")


def collector_report(df: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """(``key``, ref_id, title, source, url, body) of collector reports; articles whose
    body failed are dropped before ids are given (S4)."""
    blocks = df.select(key, F.posexplode(F.split(value, r"(?m)^(?=\[文章 ?\d+\])")).alias("pos", "block")).where(F.col("block").rlike(r"^\[文章 ?\d+\]"))
    head = r"^\[文章 ?\d+\]\s*(.*?)\s*(?:\[([^\]\n]*)\])?\s*\n"
    parsed = blocks.select(
        key, "pos",
        F.regexp_extract("block", head, 1).alias("title"), F.regexp_extract("block", head, 2).alias("source"),
        F.regexp_extract("block", r"(?m)^URL: ?(\S*)", 1).alias("url"), _strip(F.regexp_extract("block", r"(?s)正文[：:]\s*(.*)$", 1)).alias("body"),
    )
    good = parsed.where((F.length("body") > 0) & ~F.col("body").rlike(r"^(抓取失败|\[失败\]|FAILED)"))
    return good.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("ref_id"), "title", "source", "url", "body")


def source_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source_id, title, url, relevance, body) of a folder of Markdown files."""
    t = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("t"))
    meta = lambda label: F.regexp_extract("t", rf"(?im)^\W*{label}\W*[:：]\W*(.+?)\s*$", 1)
    body = F.regexp_replace("t", r"(?s)^.*?(?m:^## .*?$)", "")
    return t.select("path", meta("Source ID").alias("source_id"), F.regexp_extract("t", r"(?m)^# (.+)$", 1).alias("title"), meta("URL").alias("url"), F.expr("try_cast(" + "regexp_extract(t, '(?im)^\\\\W*Relevance score\\\\W*[:：]\\\\W*([0-9.]+)', 1) as double)").alias("relevance"), F.when(F.col("t").contains("\n## "), _strip(body)).otherwise(_strip(F.col("t"))).alias("body"))


def frequencies(df: DataFrame, value: str = "value") -> DataFrame:
    """(term, freq) of JSON objects of counts."""
    return df.select(F.explode(F.from_json(value, "map<string,bigint>")).alias("term", "freq"))


def verb_senses(df: DataFrame, value: str = "value") -> DataFrame:
    """(lemma, sense_id, definition, examples) of a dictionary in list or map form."""
    sense = "array<struct<definition:string,examples:array<string>>>"
    as_list = F.from_json(value, f"array<struct<lemma:string,senses:{sense}>>")
    as_map = F.map_entries(F.from_json(value, f"map<string,struct<lemma:string,senses:{sense}>>"))
    entries = F.when(F.trim(value).startswith("["), as_list).otherwise(F.transform(as_map, lambda e: F.struct(F.coalesce(e["value"]["lemma"], e["key"]).alias("lemma"), e["value"]["senses"].alias("senses"))))
    rows = df.select(F.explode(entries).alias("e")).select("e.lemma", F.posexplode("e.senses").alias("sense_id", "s"))
    return rows.select(F.element_at(F.split("lemma", "-"), 1).alias("lemma"), "sense_id", "s.definition", "s.examples")


def csv_with_bom(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file whose first header may begin with a byte-order mark."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.replace("﻿", "") for c in df.columns])


def search_results(df: DataFrame, value: str = "value") -> DataFrame:
    """(url, title, summary, content) of a reply in any of four layouts."""
    item = "struct<url:string,title:string,summary:string,content:string>"
    flat = F.from_json(value, f"array<{item}>")
    deep = F.flatten(F.from_json(value, f"array<array<{item}>>"))
    wrapped = F.from_json(value, f"struct<results:array<{item}>,search_results:array<{item}>>")
    first = F.when(F.trim(value).rlike(r"^\[\s*\["), deep).when(F.trim(value).startswith("["), flat).otherwise(F.coalesce(wrapped["results"], wrapped["search_results"]))
    return df.select(F.explode(first).alias("r")).select("r.*")


def cluster_listing(df: DataFrame, value: str = "value", least_parts: int = 3) -> DataFrame:
    """(topic_no, freq, idx, verb, obj, entities, sent_id) of lines
    ``Topic j (freq): idx/verb/obj/x[TYPE]/…/sent_id, …`` (S20, S21)."""
    line = df.select(F.explode(F.split(value, r"\r?\n")).alias("line"))
    head = line.select(F.regexp_extract("line", r"^Topic (\d+) \((\d+)\):", 1).alias("t"), F.regexp_extract("line", r"^Topic (\d+) \((\d+)\):", 2).alias("f"), F.regexp_replace("line", r"^Topic \d+ \(\d+\):\s*", "").alias("rest")).where("t <> ''")
    items = head.select(F.col("t").cast("int").alias("topic_no"), F.col("f").cast("long").alias("freq"), F.posexplode(F.split("rest", r",\s*")).alias("rank", "item"))
    p = F.split("item", "/")
    last = F.expr("try_cast(element_at(split(item, '/'), -1) as bigint)")
    ents = F.filter(F.transform(F.regexp_extract_all("item", F.lit(r"/([^/\[\]]+)\[[A-Z_]+\]"), 1), lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    parsed = items.where((F.size(p) >= least_parts) & last.isNotNull())
    return parsed.select("topic_no", "freq", "rank", F.expr("try_cast(split(item, '/')[0] as int)").alias("idx"), F.try_element_at(p, F.lit(2)).alias("verb"), F.try_element_at(p, F.lit(3)).alias("obj"), ents.alias("entities"), last.alias("sent_id"))


def matched_sentences(df: DataFrame, value: str = "value") -> DataFrame:
    """(topic, sentence) of a match report: only lines with a sentence id count, the
    topic is the header above (S22, W6)."""
    lines = df.withColumn("_report", F.monotonically_increasing_id()).select("_report", F.posexplode(F.split(value, r"\r?\n")).alias("pos", "line"))
    topic = F.when(F.col("line").rlike(r"^Topic \d+"), F.regexp_extract("line", r"^(Topic \d+)", 1))
    filled = lines.withColumn("topic", F.last(topic, ignorenulls=True).over(Window.partitionBy("_report").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where(F.col("line").rlike(r"^\s*\[sent_id=")).select("topic", _strip(F.regexp_replace("line", r"^(\s*\[[^\]]*\])+\s*", "")).alias("sentence"))


def write_records(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, one folder per value of ``by`` overwritten alone (K5-K8)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(by) if by else w).json(path)


def listing_lines(items: DataFrame, cluster: str, freq: str, rank: str, item: str) -> DataFrame:
    """(line) of a cluster listing (K2)."""
    g = items.groupBy(cluster).agg(F.sum(freq).alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item]), ", ").alias("body"))
    return g.select(F.format_string("Topic %d (%d): %s", F.col(cluster), F.col("f"), "body").alias("line"))


def tasks(df: DataFrame, value: str = "value") -> DataFrame:
    """(topic, domain) of task files: objects of a domain and its topics."""
    t = df.select(F.explode(F.from_json(value, "array<struct<domain:string,topics:array<string>>>")).alias("t"))
    return t.select(F.col("t.domain").alias("domain"), F.explode("t.topics").alias("topic")).where(F.trim("topic") != "").select("topic", "domain").dropDuplicates(["topic"])


def auxiliary_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """(``key``, ``vector``) of a table of extra vectors; an empty table where there is
    none, so that features of it become zeros (H21)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{key} long, {vector} array<float>")
    return spark.read.parquet(path).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<float>").alias(vector)).dropDuplicates([key])
