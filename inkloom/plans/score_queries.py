"""Score tables, set operations, sequences and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import sequence, stats, text
from .common import registry, table

QUERIES, SQL, query = registry()


def _event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a long table of scores: method, topic, metric, score."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(F.col("event_type").alias("method"), F.col("user_id").alias("topic"), (F.col("event_id") % 10).alias("metric"), "event_id", (F.col("value") % 6).alias("score"), F.lit(None).cast("string").alias("status"))


SCORES = "s AS (SELECT event_type AS method, user_id AS topic, event_id % 10 AS metric, event_id, value % 6 AS score FROM events), v AS (SELECT * FROM s WHERE score BETWEEN 0 AND 5)"


@query(f"WITH {SCORES} SELECT method, count(*) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std FROM v GROUP BY method")
def run_summary(spark, sf_dir):
    """Mean, deviation and count of valid scores."""
    s = stats.means(stats.valid_scores(_event_scores(spark, sf_dir)), ["method"])
    return s.select("method", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {SCORES}, m AS (SELECT method, metric, avg(score) AS m FROM v GROUP BY ALL), g AS (SELECT method, CASE WHEN metric < 3 THEN 'content' WHEN metric < 6 THEN 'evidence' ELSE 'form' END AS grp, avg(m) AS mean FROM m GROUP BY ALL)
SELECT method, grp, round(mean, 6) AS mean FROM g UNION ALL SELECT method, 'overall', round(avg(mean), 6) FROM g GROUP BY method""")
def score_group_rollup(spark, sf_dir):
    """Metric means, group means, unweighted overall."""
    group = F.when(F.col("metric") < 3, "content").when(F.col("metric") < 6, "evidence").otherwise("form")
    g = stats.group_means(stats.valid_scores(_event_scores(spark, sf_dir)), "method", "metric", group, "score")
    return g.select("method", "grp", F.round("mean", 6).alias("mean"))


@query(f"WITH {SCORES}, o AS (SELECT topic, method, avg(score) AS v FROM v GROUP BY ALL) SELECT a.method AS a, b.method AS b, count(*) AS n, round(avg(a.v - b.v), 6) AS mean_diff FROM o a JOIN o b USING (topic) WHERE a.method < b.method GROUP BY ALL")
def paired_differences(spark, sf_dir):
    """Mean difference of each pair of methods over common topics."""
    d = stats.paired_difference(stats.valid_scores(_event_scores(spark, sf_dir)), "topic", "method", "score")
    return d.withColumn("mean_diff", F.round("mean_diff", 6))


@query(f"WITH {SCORES}, m AS (SELECT count(DISTINCT method) AS k FROM v), f AS (SELECT topic FROM v, m GROUP BY topic HAVING count(DISTINCT method) = max(k)) SELECT topic, count(*) AS n FROM v WHERE topic IN (SELECT topic FROM f) GROUP BY topic")
def common_topics(spark, sf_dir):
    """Rows of topics that every method has."""
    v = stats.valid_scores(_event_scores(spark, sf_dir))
    n = v.agg(F.count_distinct("method").alias("_k"))
    full = v.groupBy("topic").agg(F.count_distinct("method").alias("_n")).crossJoin(F.broadcast(n)).where("_n = _k").select("topic")
    return v.join(full, "topic", "left_semi").groupBy("topic").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_returnflag || l_linestatus AS name, avg(l_discount) / 2 AS p FROM lineitem GROUP BY ALL), r AS (SELECT name, p, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM p)
SELECT name, round(p, 9) AS p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, name), 9) AS p_holm FROM r""")
def holm_adjust(spark, sf_dir):
    """Step-down adjustment."""
    p = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_discount").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg((F.avg("l_discount") / 2).alias("p"))
    return stats_round(sequence.holm(p, "p", ["name"]), 9, "p", "p_holm")


def stats_round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""WITH v AS (SELECT l_linestatus AS metric, l_returnflag AS method, round(avg(l_extendedprice), 6) AS value FROM lineitem GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY metric ORDER BY value DESC) AS r FROM v)
SELECT metric, method, round(value, 4) AS value, CASE r WHEN 1 THEN 'best' WHEN 2 THEN 'second' END AS mark FROM r""")
def best_and_second(spark, sf_dir):
    """Best and runner-up of each column."""
    v = table(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice").groupBy(F.col("l_linestatus").alias("metric"), F.col("l_returnflag").alias("method")).agg(F.round(F.avg("l_extendedprice"), 6).alias("value"))
    return stats.best_and_second(v, "metric", "value").withColumn("value", F.round("value", 4))


@query("""WITH t AS (SELECT l_linenumber AS k, avg(l_discount) AS sil, avg(l_tax) + 0.5 AS dbi, avg(CAST(l_quantity < 5 AS DOUBLE)) AS small FROM lineitem GROUP BY k),
q AS (SELECT k, 50 * (sil / max(sil) OVER () + min(dbi) OVER () / dbi) AS quality, 100 * (1 - small) AS support FROM t)
SELECT k, round(quality, 6) AS quality, round(support, 6) AS support, round(CASE WHEN quality + support = 0 THEN 0 ELSE 2 * quality * support / (quality + support) END, 6) AS balance FROM q""")
def balance_score_table(spark, sf_dir):
    """Quality, support and balance for each k."""
    l = table(spark, sf_dir, "lineitem", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    per = l.select(F.col("l_linenumber").alias("k"), F.col("l_discount").alias("silhouette"), (F.col("l_tax") + 0.5).alias("dbi"), (F.col("l_quantity") < 5).cast("double").alias("small_ratio"))
    return stats_round(stats.balance(per), 6, "quality", "support", "balance")


@query("SELECT n_name AS domain, o_orderpriority AS method, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def domain_method_means(spark, sf_dir):
    """Means by domain and method over a join that must match."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_custkey", "o_custkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name").withColumnRenamed("n_nationkey", "c_nationkey")
    j = sequence.matched_or_fail(sequence.matched_or_fail(o, c, "o_custkey"), n, "c_nationkey")
    return j.groupBy(F.col("n_name").alias("domain"), F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT coalesce(trim(domain), 'none') AS domain, count(*) AS n, list_sort(list(id)) AS ids FROM topics GROUP BY ALL")
def domain_counts(spark, sf_dir):
    """Topics of each domain."""
    return table(spark, sf_dir, "topics", "id", "domain").groupBy(F.coalesce(F.trim("domain"), F.lit("none")).alias("domain")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


@query("SELECT DISTINCT ref_id FROM source_documents WHERE ref_id NOT IN (SELECT ref_id FROM evidence_chunks WHERE ref_id IS NOT NULL)")
def resume_anti_join(spark, sf_dir):
    """Sources that have no chunks yet."""
    return sequence.resume(table(spark, sf_dir, "source_documents", "ref_id").distinct(), table(spark, sf_dir, "evidence_chunks", "ref_id").distinct(), ["ref_id"])


@query("WITH a AS (SELECT DISTINCT topic_id FROM documents WHERE method = 'baseline'), b AS (SELECT DISTINCT topic_id FROM search_results WHERE source = 'jina') (SELECT 'left' AS side, topic_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT 'right', topic_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) UNION ALL (SELECT 'both', topic_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b))")
def topic_set_operations(spark, sf_dir):
    """Intersection and both differences of two topic sets."""
    a = table(spark, sf_dir, "documents", "topic_id", "method").where("method = 'baseline'").select("topic_id").distinct()
    b = table(spark, sf_dir, "search_results", "topic_id", "source").where("source = 'jina'").select("topic_id").distinct()
    side = lambda name, df: df.select(F.lit(name).alias("side"), "topic_id")
    return side("left", a.subtract(b)).unionByName(side("right", b.subtract(a))).unionByName(side("both", a.intersect(b)))


@query("WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS refs FROM lineitem GROUP BY l_orderkey) SELECT refs, count(*) AS n, min(l_orderkey) AS first_order FROM s GROUP BY refs")
def reference_set_groups(spark, sf_dir):
    """Records with one set of references."""
    s = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("refs"))
    return s.groupBy("refs").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("WITH n AS (SELECT o_custkey AS key, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM n) SELECT key, value, n FROM r WHERE r = 1")
def mode_with_ties(spark, sf_dir):
    """Most frequent values, all of a tie."""
    from ..operators import graph

    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return graph.modes(o, "key", "value")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, date_trunc('day', ts) AS d FROM events), c AS (SELECT user_id, d, event_type, min(struct_pack(ts := ts, e := event_id)) AS f FROM e GROUP BY ALL),
t AS (SELECT user_id, d, string_agg(event_type, '>' ORDER BY f) AS template FROM c GROUP BY ALL) SELECT template, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM t GROUP BY template""")
def event_templates(spark, sf_dir):
    """Order in which a user's kinds of event first occur in a day."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").withColumn("d", F.date_trunc("day", "ts"))
    first = e.groupBy("user_id", "d", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    t = first.groupBy("user_id", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ">").alias("template"))
    n = t.groupBy("template").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


TRANSITIONS = "p AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), n AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL)"


@query(f"WITH {TRANSITIONS} SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 9) AS share FROM n")
def event_transitions(spark, sf_dir):
    """Neighbouring events and their share."""
    return sequence.transitions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").withColumn("share", F.round("share", 9))


@query(f"WITH {TRANSITIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM n) SELECT src, dst, n, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 3")
def event_transitions_top3(spark, sf_dir):
    """Three most frequent successors."""
    t = sequence.transitions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return sequence.top_k(t, ["src"], [F.desc("n"), "dst"], 3).select("src", "dst", "n", "rn")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events""")
def event_fill_down(spark, sf_dir):
    """Latest click up to each event."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return sequence.fill_down(e, F.when(F.col("event_type") == "click", F.col("event_id")), ["user_id"], ["ts", "event_id"], "last_click").select("event_id", "user_id", "last_click")


HEADINGS = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS seq, length(regexp_extract(line, '^(#{1,4})\s', 1)) AS level, trim(regexp_replace(line, '^#+\s*|\r$', '', 'g')) AS title FROM l WHERE regexp_matches(line, '^#{1,4}\s'))"""


def _headings(spark, sf_dir) -> DataFrame:
    """(doc_id, seq, level, title) of Markdown headings."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^#{1,4}\s"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return d.select("doc_id", F.row_number().over(w).alias("seq"), F.length(F.regexp_extract("line", r"^(#{1,4})\s", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s*|\r$", "")).alias("title"))


@query(f"WITH {HEADINGS} SELECT doc_id, seq, CAST(level AS INTEGER) AS level, title, (SELECT max(b.seq) FROM h b WHERE b.doc_id = a.doc_id AND b.seq < a.seq AND b.level < a.level) AS parent_seq FROM h a")
def heading_parents(spark, sf_dir):
    """Parent of each heading."""
    return sequence.heading_parents(_headings(spark, sf_dir), "doc_id", "seq", "level")


@query(f"WITH {HEADINGS}, m AS (SELECT *, max(seq) OVER (PARTITION BY doc_id) AS last FROM h), b AS (SELECT doc_id, level, count(*) AS n, avg(seq / last) AS pos FROM m GROUP BY ALL) SELECT CAST(level AS INTEGER) AS level, count(*) AS docs, round(avg(n), 6) AS mean_n, round(quantile_cont(pos, 0.5), 6) AS p50, round(quantile_cont(pos, 0.9), 6) AS p90 FROM b GROUP BY level")
def category_position_stats(spark, sf_dir):
    """Place of each level within documents."""
    h = _headings(spark, sf_dir).withColumn("last", F.max("seq").over(Window.partitionBy("doc_id")))
    b = h.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.avg(F.col("seq") / F.col("last")).alias("pos"))
    return b.groupBy("level").agg(F.count("*").alias("docs"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.percentile("pos", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("pos", F.lit(0.9)), 6).alias("p90"))


@query(f"WITH {HEADINGS} SELECT doc_id, string_agg(level || ':' || title, chr(10) ORDER BY seq) AS outline, count(*) AS n FROM h GROUP BY doc_id")
def outlines_exported(spark, sf_dir):
    """Headings of each document in one record (K7, K4)."""
    h = _headings(spark, sf_dir)
    return h.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "level", "title").alias("x")))), lambda r: r["x"]), "\n").alias("outline"), F.count("*").alias("n"))


@query(f"WITH {HEADINGS} SELECT DISTINCT title, trim(regexp_replace(regexp_replace(regexp_replace(title, '^\\s*第[一二三四五六七八九十0-9]+[章节部分]\\s*', ''), '^\\s*[一二三四五六七八九十]+、\\s*', ''), '^\\s*[0-9]+(\\.[0-9]+)*[.、)]?\\s+', '')) AS clean, regexp_matches(title, '[0-9]') AND regexp_matches(title, '[A-Z\\x{{4e00}}-\\x{{9fff}}]') AS is_candidate FROM h")
def clean_titles(spark, sf_dir):
    """Headings without numbering; table-of-contents candidates."""
    t = _headings(spark, sf_dir).select("title").distinct()
    return t.select("title", text.clean_title(F.col("title")).alias("clean"), (F.col("title").rlike("[0-9]") & F.col("title").rlike(r"[A-Z\x{4e00}-\x{9fff}]")).alias("is_candidate"))


@query("WITH f AS (SELECT p_brand AS key, min(p_partkey) AS f FROM part GROUP BY p_brand) SELECT key, row_number() OVER (ORDER BY f, key) - 1 AS id FROM f")
def dense_ids(spark, sf_dir):
    """Ids in order of first appearance."""
    return sequence.dense_ids(table(spark, sf_dir, "part", "p_partkey", "p_brand").withColumnRenamed("p_brand", "key"), "key", "p_partkey")


@query("SELECT source, doc_id, CAST(rn AS INTEGER) AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) AS rn FROM documents) WHERE rn <= 2")
def per_source_cap(spark, sf_dir):
    """Two longest documents of each source."""
    d = table(spark, sf_dir, "documents", "source", "doc_id", "text").select("source", "doc_id", F.length("text").alias("n"))
    return sequence.top_k(d, ["source"], [F.desc_nulls_last("n"), "doc_id"], 2).select("source", "doc_id", "rn")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, sf_dir):
    """Hourly counts, by the streaming plan run as a batch (extension)."""
    from ..streaming import windows

    return windows.tumbling(table(spark, sf_dir, "events", "ts", "event_type"), "1 hour")


PAIRED = f"{SCORES}, o AS (SELECT topic, method, avg(score) AS v FROM v GROUP BY ALL), d AS (SELECT a.method AS a, b.method AS b, a.topic, round(a.v - b.v, 12) AS d FROM o a JOIN o b ON a.topic = b.topic AND a.method < b.method)"


def _paired(spark, sf_dir) -> DataFrame:
    v = stats.valid_scores(_event_scores(spark, sf_dir)).groupBy("topic", "method").agg(F.avg("score").alias("v"))
    a, b = v.select("topic", F.col("method").alias("a"), F.col("v").alias("va")), v.select("topic", F.col("method").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "topic").where("a < b").select("a", "b", "topic", F.round(F.col("va") - F.col("vb"), 12).alias("d"))


@query(f"""WITH {PAIRED}, c AS (SELECT a, b, abs(d) AS s, count(*) AS t, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY ALL), r AS (SELECT *, sum(t) OVER (PARTITION BY a, b ORDER BY s) - t + (t + 1) / 2.0 AS r FROM c),
x AS (SELECT a, b, sum(t)::DOUBLE AS n, sum(r * up) AS up, sum(r * (t - up)) AS down, sum(t::DOUBLE ** 3 - t) AS ties FROM r GROUP BY ALL)
SELECT a, b, CAST(n AS BIGINT) AS n, CAST(least(up, down) AS DOUBLE) AS w, round(greatest(0, (abs(least(up, down) - n * (n + 1) / 4) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)), 6) AS z FROM x""")
def signed_rank_statistics(spark, sf_dir):
    """Signed ranks of each pair of methods."""
    return stats.signed_ranks(_paired(spark, sf_dir), ["a", "b"], "d").select("a", "b", "n", "w", F.round("z", 6).alias("z"))


@query()
def method_significance(spark, sf_dir):
    """Wilcoxon and bootstrap of each pair of methods."""
    d = _paired(spark, sf_dir)
    ranks = stats.signed_ranks(d, ["a", "b"], "d").withColumn("p", stats.two_sided(F.col("z")))
    return ranks.join(stats.bootstrap_intervals(d, ["a", "b"], "topic", "d"), ["a", "b"]).select("a", "b", "w", "p", "low", "high")
