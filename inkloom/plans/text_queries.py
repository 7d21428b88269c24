"""Text, keep-first, chunk, retrieval and citation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import citations, retrieval, sequence, text
from ..session import spread_again
from .common import registry, table

QUERIES, SQL, query = registry()
HAN = r"[\x{4e00}-\x{9fff}]"
#: DuckDB: tokens of ``{0}`` as a list.
TOKENS = r"""list_concat(regexp_extract_all(lower({0}), '[a-z][a-z0-9_+.\-]+'), flatten(list_transform(regexp_extract_all(lower({0}), '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: CASE WHEN length(r) <= 2 THEN [r] ELSE list_concat(list_transform(range(1, length(r)), lambda i: r[i:i + 1]), list_transform(range(1, length(r) - 1), lambda i: r[i:i + 2])) END)))"""
DOC_TOKENS = f"t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL)"
BM25_TERMS = ("privacy", "缓存", "latency", "接口", "module")


@query(f"""WITH {DOC_TOKENS}, l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
r AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.35 / (tf + 1.35 * (0.28 + 0.72 * dl / avgdl))) AS score FROM p JOIN d USING (token) JOIN l USING (doc_id), s WHERE token IN {BM25_TERMS} GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 10""")
def bm25_top_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: BM25 over all documents, best ten."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    asked = spark.sql("SELECT 1 AS query_id, token, 1 AS qtf FROM VALUES " + ", ".join(f"('{t}')" for t in BM25_TERMS) + " AS t(token)")
    scored = retrieval.bm25(retrieval.arrays(docs, ["doc_id"], F.col("text")), ["doc_id"], asked)
    return scored.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {DOC_TOKENS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p) SELECT token, count(*) AS df, round(ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, n GROUP BY token")
def token_df_idf(spark, sf_dir):
    """Document frequency of every token (A3)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    arrays = retrieval.arrays(docs, ["doc_id"], F.col("text"))
    counted = retrieval.frequencies(arrays).crossJoin(F.broadcast(retrieval.totals(arrays)))
    return counted.select("token", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"""WITH {DOC_TOKENS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
w AS (SELECT doc_id, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM p JOIN d USING (token), n) SELECT doc_id, count(*) AS n_tokens, round(sqrt(sum(w * w)), 5) AS length FROM w GROUP BY doc_id""")
def tf_idf_lengths(spark, sf_dir):
    """Length of each document's TF-IDF row before it is normalised (M6)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    posts = retrieval.postings(docs, ["doc_id"], F.col("text"))
    n = posts.select("doc_id").distinct().agg(F.count("*").alias("n"))
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    w = posts.join(df, "token").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 5).alias("length"))


@query(f"""WITH c AS (SELECT DISTINCT ref_id, chunk_id, text, title, relevance FROM evidence_chunks WHERE text IS NOT NULL),
t AS (SELECT ref_id, chunk_id, unnest({TOKENS.format("coalesce(title, '') || ' ' || text")}) AS token FROM c), p AS (SELECT ref_id, chunk_id, token, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT ref_id, chunk_id, CAST(sum(tf) AS BIGINT) AS dl FROM p GROUP BY ALL) SELECT ref_id, chunk_id, dl, n_distinct FROM l JOIN (SELECT ref_id, chunk_id, count(*) AS n_distinct FROM p GROUP BY ALL) USING (ref_id, chunk_id)""")
def chunk_token_stats(spark, sf_dir):
    """Token multiset of title and chunk (A4)."""
    c = table(spark, sf_dir, "evidence_chunks", "ref_id", "chunk_id", "text", "title", "relevance").where("text is not null").distinct()
    posts = retrieval.postings(c, ["ref_id", "chunk_id"], F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("text")))
    return posts.groupBy("ref_id", "chunk_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("n_distinct"))


def _topic_ranking(spark, sf_dir) -> DataFrame:
    """(topic_id, ref_id, chunk_id, chars, score) of each topic over the chunks of its own
    sources, with the relevance and title bonus (T5).  What a chunk adds to its score is
    worked out in its own row and carried along, so the chunks are read once."""
    keys = ["ref_id", "chunk_id"]
    raw = table(spark, sf_dir, "evidence_chunks", *keys, "title", "relevance", "text").where("text is not null")
    c = spread_again(sequence.keep_first(raw, keys, [F.coalesce("title", F.lit("")), F.coalesce("relevance", F.lit(-1.0)), "text"]), raw)
    topics = table(spark, sf_dir, "topics", "id", "title").select(F.col("id").alias("topic_id"), F.trim("title").alias("topic"))
    asked = retrieval.query_tokens(topics, "topic_id", F.col("topic")).withColumn("topic_id", F.col("query_id"))
    wanted = topics.select("topic_id", F.array_distinct(text.tokens(F.col("topic"))).alias("wanted"))
    owner = table(spark, sf_dir, "source_documents", "ref_id", "topic_id").groupBy("ref_id").agg(F.min("topic_id").alias("topic_id")).join(wanted, "topic_id", "left")
    common = F.coalesce(F.size(F.array_intersect(text.tokens(F.coalesce("title", F.lit(""))), F.coalesce("wanted", F.array().cast("array<string>")))), F.lit(0))
    own = 0.35 * F.least(F.lit(0.8), F.coalesce("relevance", F.lit(0.0))) + 0.25 * common
    docs = c.join(owner, "ref_id", "left").select(*keys, "topic_id", F.length("text").alias("chars"), own.alias("own"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("text")).alias("all"))
    carried = [*keys, "chars", "own"]
    s = retrieval.bm25(retrieval.arrays(docs, [*carried, "topic_id"], F.col("all")), carried, asked, on=("topic_id", "token"))
    return s.select(F.col("query_id").alias("topic_id"), *keys, "chars", (F.col("score") + F.col("own")).alias("score"))


RANKED = f"""c AS (SELECT ref_id, chunk_id, min(struct_pack(a := coalesce(title, ''), b := coalesce(relevance, -1.0), text := text, title := title, relevance := relevance)) AS s FROM evidence_chunks WHERE text IS NOT NULL GROUP BY ALL),
e AS (SELECT ref_id, chunk_id, s.text AS text, s.title AS title, s.relevance AS relevance FROM c),
t AS (SELECT ref_id, chunk_id, unnest({TOKENS.format("coalesce(title, '') || ' ' || text")}) AS token FROM e), p AS (SELECT ref_id, chunk_id, token, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT id AS topic_id, unnest({TOKENS.format("trim(title)")}) AS token FROM topics), qq AS (SELECT topic_id, token, count(*) AS qtf FROM q GROUP BY ALL),
o AS (SELECT ref_id, min(topic_id) AS topic_id FROM source_documents GROUP BY ref_id), l AS (SELECT ref_id, chunk_id, sum(tf) AS dl FROM p GROUP BY ALL), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
b AS (SELECT topic_id, ref_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.35 / (tf + 1.35 * (0.28 + 0.72 * dl / avgdl)) * least(qtf, 2)) AS base FROM p JOIN o USING (ref_id) JOIN qq USING (topic_id, token) JOIN d USING (token) JOIN l USING (ref_id, chunk_id), s GROUP BY ALL),
tt AS (SELECT ref_id, chunk_id, unnest(list_distinct({TOKENS.format("coalesce(title, '')")})) AS token FROM e), u AS (SELECT ref_id, chunk_id, count(*) AS common FROM tt JOIN o USING (ref_id) JOIN qq USING (topic_id, token) GROUP BY ALL),
r AS (SELECT topic_id, ref_id, chunk_id, round(base + 0.35 * least(0.8, coalesce(relevance, 0)) + 0.25 * coalesce(common, 0), 6) AS score FROM b JOIN e USING (ref_id, chunk_id) LEFT JOIN u USING (ref_id, chunk_id))"""


@query(f"""WITH {RANKED},
k AS (SELECT *, row_number() OVER (PARTITION BY topic_id, ref_id ORDER BY score DESC, chunk_id) AS per, FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, ref_id, chunk_id) AS rn FROM k WHERE per <= 2)
SELECT topic_id, ref_id, chunk_id, score, CAST(rn AS INTEGER) AS rn FROM m WHERE rn <= 12""")
def topic_evidence_ranked(spark, sf_dir):
    """Best twelve chunks of each topic, two a source."""
    r = _topic_ranking(spark, sf_dir).withColumn("score", F.round("score", 6))
    capped = sequence.top_k(r, ["topic_id", "ref_id"], [F.desc("score"), "chunk_id"], 2, "per")
    return sequence.top_k(capped, ["topic_id"], [F.desc("score"), "ref_id", "chunk_id"], 12).select("topic_id", "ref_id", "chunk_id", "score", "rn")


@query(f"""WITH RECURSIVE {RANKED},
z AS (SELECT topic_id, ref_id, chunk_id, length(e.text) AS chars, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, ref_id, chunk_id) AS i FROM r JOIN e USING (ref_id, chunk_id) WHERE score > 0),
w AS (SELECT topic_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, CAST([] AS INTEGER[]) AS refs, CAST(NULL AS INTEGER) AS ref_id, CAST(NULL AS INTEGER) AS chunk_id, CAST(NULL AS BIGINT) AS chars, false AS ok FROM (SELECT DISTINCT topic_id FROM z)
UNION ALL SELECT topic_id, n.i, CASE WHEN n.fits THEN n.total + n.chars ELSE n.total END, CASE WHEN n.fits THEN list_append(n.refs, n.ref_id) ELSE n.refs END, n.ref_id, n.chunk_id, n.chars, n.fits FROM
(SELECT w.topic_id, z.i, w.total, w.refs, z.ref_id, z.chunk_id, z.chars, len(list_filter(w.refs, lambda x: x = z.ref_id)) < 2 AND (len(w.refs) = 0 OR w.total + z.chars <= 14500) AS fits FROM w JOIN z ON z.topic_id = w.topic_id AND z.i = w.i + 1 WHERE len(w.refs) < 12) n)
SELECT topic_id, ref_id, chunk_id, CAST(chars AS INTEGER) AS chars, len(refs) AS taken FROM w WHERE ok""")
def topic_evidence_budgeted(spark, sf_dir):
    """Greedy evidence of each topic under the character budget."""
    r = _topic_ranking(spark, sf_dir).withColumn("score", F.round("score", 6))
    out = retrieval.select_within_budget(r, "topic_id", ["ref_id", "chunk_id"], "ref_id", "chars")
    return out.select("topic_id", "ref_id", "chunk_id", "chars", "taken")


LINES = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, pos, regexp_replace(raw, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM l)"


def _doc_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "pos", F.regexp_replace("raw", r"^[ \t\r]+|[ \t\r]+$", "").alias("line"))


@query(f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS r FROM s WHERE line <> '') WHERE r = 1")
def line_dedup_keep_first(spark, sf_dir):
    """First occurrence of each stripped line."""
    return sequence.keep_first(_doc_lines(spark, sf_dir).where("line <> ''"), ["line"], ["doc_id", "pos"]).select("doc_id", "pos", "line")


@query(f"WITH {LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS sent_id, length(line) AS chars FROM s WHERE line <> ''")
def corpus_lines(spark, sf_dir):
    """Non-blank lines of each document with dense ids from 0."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return _doc_lines(spark, sf_dir).where("line <> ''").select("doc_id", (F.row_number().over(w) - 1).alias("sent_id"), F.length("line").cast("long").alias("chars"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def exact_digest_groups(spark, sf_dir):
    """Documents of one text."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return d.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, CAST(unnest(range(ceil(greatest(length(text) - 50, 1) / 100.0)::BIGINT)) AS INTEGER) AS chunk_id, substr(text, 1 + 100 * unnest(range(ceil(greatest(length(text) - 50, 1) / 100.0)::BIGINT)), 150) AS chunk FROM documents WHERE length(text) > 0")
def chunk_fixed_overlap(spark, sf_dir):
    """Chunks of 150 signs, 50 shared."""
    return retrieval.fixed_chunks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 150, 50)


@query(r"""WITH d AS (SELECT DISTINCT ref_id, body FROM source_documents WHERE length(body) > 0), p AS (SELECT ref_id, body, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '(?m)^(#{1,4}\s)', chr(1) || '\1', 'g'), '\n\s*\n|\x01'),
lambda x: trim(regexp_replace(regexp_replace(x, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[\x{200b}\x{feff}]', '', 'g'))), lambda x: length(x) >= 30) AS p FROM d),
f AS (SELECT ref_id, list_reduce(list_transform(p, lambda x: {'done': CAST([] AS VARCHAR[]), 'open': x, 'size': length(x)}), lambda a, x: CASE WHEN length(x.open) > 1800 THEN
{'done': list_concat(CASE WHEN a.size > 0 AND a.size + length(x.open) > 900 THEN list_append(a.done, a.open) ELSE a.done END, list_filter(list_transform(range(0, (length(x.open) - 1) // 900 + 1), lambda i: substr(x.open, CAST(i * 900 + 1 AS BIGINT), 900)), lambda s: length(s) >= 80)), 'open': CASE WHEN a.size > 0 AND a.size + length(x.open) > 900 THEN '' ELSE a.open END, 'size': CASE WHEN a.size > 0 AND a.size + length(x.open) > 900 THEN 0 ELSE a.size END}
WHEN a.size > 0 AND a.size + length(x.open) > 900 THEN {'done': list_append(a.done, a.open), 'open': x.open, 'size': length(x.open)}
WHEN a.size > 0 THEN {'done': a.done, 'open': a.open || chr(10) || x.open, 'size': a.size + length(x.open)} ELSE {'done': a.done, 'open': x.open, 'size': length(x.open)} END, {'done': CAST([] AS VARCHAR[]), 'open': '', 'size': CAST(0 AS BIGINT)}) AS f FROM p),
c AS (SELECT ref_id, unnest(l) AS chunk, unnest(range(len(l))) AS chunk_id FROM (SELECT ref_id, CASE WHEN f.size > 0 THEN list_append(f.done, f.open) ELSE f.done END AS l FROM f)),
n AS (SELECT *, sha1(regexp_replace(chunk, '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+', '', 'g')) AS digest, len(regexp_extract_all(chunk, '\[[^\]]+\]\([^\)]+\)')) AS links, len(regexp_extract_all(chunk, '!\[')) AS images FROM c)
SELECT ref_id, CAST(chunk_id AS INTEGER) AS chunk_id, chunk, digest FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, digest ORDER BY chunk_id) AS r FROM n WHERE NOT (links >= 6 OR images >= 2 OR (links >= 3 AND regexp_matches(chunk, '返回\+|热门推荐|产品与解决方案|行业解决方案|营销资料')))) WHERE r = 1""")
def evidence_chunks_packed(spark, sf_dir):
    """Packed paragraphs without navigation blocks and repeats."""
    docs = table(spark, sf_dir, "source_documents", "ref_id", "body").where("body is not null").distinct()
    return retrieval.evidence_chunks(docs, "ref_id", "body")


@query()
def chunks_recursive(spark, sf_dir):
    """Recursive splitter, 150 / 50."""
    return retrieval.recursive_chunks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query(r"""WITH d AS (SELECT DISTINCT id, content FROM search_results WHERE content IS NOT NULL), l AS (SELECT id, unnest(regexp_split_to_array(content, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS raw FROM d),
s AS (SELECT id, regexp_replace(regexp_replace(raw, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'), '^\p{Nd}+[、．.][\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]*', '') AS line FROM l),
c AS (SELECT id, line, length(line) AS n, length(regexp_replace(line, '[^\p{Nd}.．。]', '', 'g')) AS digits, length(regexp_replace(line, '[^\x21-\x7e]', '', 'g')) AS ascii, length(regexp_replace(line, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g')) AS han, length(regexp_replace(line, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) AS seen,
length(regexp_replace(line, '[\x00-\x7f\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]', '', 'g')) AS odd FROM s WHERE length(line) >= 20)
SELECT id, count(*) AS n_kept, CAST(sum(n) AS BIGINT) AS kept_chars FROM c WHERE digits / n <= 0.4 AND ascii / n <= 0.8 AND han / seen >= 0.6 AND odd / n <= 0.6 GROUP BY id""")
def clean_lines_ratio(spark, sf_dir):
    """Lines that the page cleaner keeps."""
    d = table(spark, sf_dir, "search_results", "id", "content").where("content is not null").distinct()
    return text.clean_lines(d, "id", "content").groupBy("id").agg(F.count("*").alias("n_kept"), F.sum(F.length("line")).alias("kept_chars"))


@query(r"""WITH c AS (SELECT DISTINCT id, content, len(regexp_extract_all(content, '\[[^\]]+\]\([^\)]+\)')) AS n_links, len(regexp_extract_all(content, '!\[')) AS images FROM search_results WHERE content IS NOT NULL)
SELECT DISTINCT id, n_links, (n_links >= 6 OR images >= 2 OR (n_links >= 3 AND regexp_matches(content, '返回\+|热门推荐|产品与解决方案|行业解决方案|营销资料'))) AS is_nav FROM c""")
def boilerplate_pages(spark, sf_dir):
    """Navigation pages."""
    d = table(spark, sf_dir, "search_results", "id", "content").where("content is not null")
    return d.select("id", F.regexp_count("content", F.lit(r"\[[^\]]+\]\([^\)]+\)")).cast("long").alias("n_links"), text.is_boilerplate(F.col("content")).alias("is_nav")).distinct()


@query(r"SELECT regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*://)?(?:www\.)?([^/?#:]*)', 1) AS host, count(DISTINCT ref_id) AS n_pages FROM source_documents WHERE url IS NOT NULL AND host <> '' AND NOT regexp_matches(host, '(^|\.)(brightfen-news\.example|lumenarc\.example)$') GROUP BY host")
def skip_domains(spark, sf_dir):
    """Pages a host, without hosts of the skip list."""
    d = table(spark, sf_dir, "source_documents", "ref_id", "url").withColumn("host", text.host(F.col("url")))
    return d.where("host is not null").where(~F.col("host").rlike(r"(^|\.)(brightfen-news\.example|lumenarc\.example)$")).groupBy("host").agg(F.count_distinct("ref_id").alias("n_pages"))


@query(r"""WITH t AS (SELECT id AS topic_id, lower(title) AS core FROM topics), c AS (SELECT topic_id, replace(replace(replace(replace(replace(replace(replace(replace(core, '技术白皮书', ''), '白皮书', ''), '技术', ''), '发展', ''), '研究', ''), '系统', ''), '平台', ''), '方案', '') AS core FROM t)
SELECT topic_id, list_sort(list_distinct(list_concat(regexp_extract_all(core, '[a-z][a-z0-9+.\-]{2,}'), flatten(list_transform(regexp_extract_all(core, '[\x{4e00}-\x{9fff}]+'), lambda r: CASE WHEN length(r) <= 3 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i:i + 1]) END))))) AS anchors FROM c""")
def topic_anchors(spark, sf_dir):
    """Lexical anchors of each topic (F8)."""
    return table(spark, sf_dir, "topics", "id", "title").select(F.col("id").alias("topic_id"), F.array_sort(text.anchors(F.col("title"))).alias("anchors"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\[\^(\d+)\]')) AS n, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\[\^(\d+)\]', 1), lambda x: CAST(x AS INTEGER)))) AS ids FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\[\^\d+\]')")
def cited_ids(spark, sf_dir):
    """Citations of each document."""
    ids = text.citation_ids(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").withColumn("i", ids).where(F.size("i") > 0).select("doc_id", F.size("i").cast("long").alias("n"), F.array_sort(F.array_distinct("i")).alias("ids"))


@query(r"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[\^(\d+)\]', 1))::INTEGER AS id, unnest(range(len(regexp_extract_all(text, '\[\^(\d+)\]')))) AS pos FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, id, count(*) AS n, min(pos) AS f FROM i GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS uniq, arg_max(id, struct_pack(n := n, f := -f)) AS dominant, round(max(n) / sum(n), 6) AS ratio FROM n GROUP BY doc_id""")
def citation_distribution(spark, sf_dir):
    """Total, unique and dominant citations."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return citations.distribution(d, "doc_id", "text").withColumn("ratio", F.round("ratio", 6))


@query(r"""WITH b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS block FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')), ' ') AS p FROM b),
k AS (SELECT doc_id, avg(regexp_matches(p, '\[\^\d+\]')::INT) AS c FROM p WHERE p <> '' AND NOT starts_with(p, '|') AND length(regexp_replace(p, '\[\^\d+\]', '', 'g')) >= 45 GROUP BY doc_id)
SELECT doc_id, round(coalesce(c, 0), 6) AS coverage FROM (SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN k USING (doc_id)""")
def paragraph_citation_coverage(spark, sf_dir):
    """Share of paragraphs with a citation."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return citations.paragraph_coverage(d, "doc_id", "text").withColumn("coverage", F.round("coverage", 6))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '(?m)^#{1,4}\s.*$', '', 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1))) AS raw FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, regexp_replace(raw, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS s FROM s),
q AS (SELECT doc_id, s, regexp_replace(s, '\[\^\d+\]', '', 'g') AS bare FROM p WHERE s <> ''),
k AS (SELECT doc_id, avg(regexp_matches(s, '\[\^\d+\]')::INT) AS c FROM q WHERE length(regexp_replace(bare, '[\s\x{0b}*`#|]', '', 'g')) >= 12 AND NOT (regexp_matches(bare, '^(\||-|[1-5]\.)') AND length(bare) < 30) GROUP BY doc_id)
SELECT doc_id, round(coalesce(c, 0), 6) AS coverage FROM (SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN k USING (doc_id)""")
def sentence_citation_coverage(spark, sf_dir):
    """Share of factual sentences with a citation."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return citations.sentence_coverage(d, "doc_id", "text").withColumn("coverage", F.round("coverage", 6))


@query(r"WITH i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\[\^(\d+)\]', 1))::INTEGER AS id FROM documents WHERE text IS NOT NULL) SELECT doc_id, id FROM i WHERE id NOT IN (SELECT ref_id FROM evidence_chunks WHERE ref_id IS NOT NULL)")
def invalid_citations(spark, sf_dir):
    """Citations of a source without evidence."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return citations.invalid(d, "doc_id", "text", table(spark, sf_dir, "evidence_chunks", "ref_id").distinct(), "ref_id").select("doc_id", F.col("cited").alias("id"))


NUMBERS = r"%|％|ms|Mbps|Gbps|GB|MB|KB|GT/s|秒|分钟|小时|位|台|个|次|倍|年|MPa|℃|V|A|W|kW|MW|kWh|平方米|m²|Pa"


@query(rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '(^|[^A-Za-z0-9])([0-9])', '\1' || chr(1) || '\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, list_transform(regexp_extract_all(t, '\x01([0-9]+(?:\.\x01?[0-9]+)?(?:\+|(?:\s*[~～—\-]\s*\x01?[0-9]+(?:\.\x01?[0-9]+)?))?\s*(?:{NUMBERS})?)', 1), lambda x: translate(lower(regexp_replace(replace(x, chr(1), ''), '\s+', '', 'g')), '％～—', '%~-')) AS v FROM m)
SELECT doc_id, CAST(len(list_filter(v, lambda x: regexp_matches(x, '[%a-z℃².+\-~]') OR CAST(regexp_extract(x, '^([0-9]+)', 1) AS HUGEINT) >= 10)) AS INTEGER) AS n_numbers FROM v""")
def number_tokens(spark, sf_dir):
    """Numbers that say something."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", F.size(text.numeric_values(F.col("text"))).alias("n_numbers"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[\x{200b}\x{feff}]', '', 'g')) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([。！？；.!?])[\s]*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 12) AS p FROM n)
SELECT doc_id, len(p) AS n_sentences, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS chars FROM p""")
def sentence_lengths(spark, sf_dir):
    """Sentence parts of each document."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").withColumn("p", text.sentence_parts(F.col("text")))
    return d.select("doc_id", F.size("p").cast("long").alias("n_sentences"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query(r"SELECT regexp_replace(lower(p_name), '[^0-9a-z\x{4e00}-\x{9fff}]', '', 'g') AS key, count(*) AS n FROM part GROUP BY key")
def canonical_name_groups(spark, sf_dir):
    """Names equal in canonical form."""
    return table(spark, sf_dir, "part", "p_name").groupBy(text.canonical(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"))


@query(r"""SELECT ref_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(title, '[\\/:*?"<>|\n\r\t]', '_', 'g'), '\s+', ' ', 'g')), 120), ''), 'untitled') AS name, left(sha1(coalesce(title, '')), 16) AS key FROM (SELECT DISTINCT ref_id, title FROM source_documents)""")
def safe_names(spark, sf_dir):
    """File names and digests of titles."""
    d = table(spark, sf_dir, "source_documents", "ref_id", "title").distinct()
    return d.select("ref_id", text.safe_name(F.col("title")).alias("name"), F.left(F.sha1(F.coalesce("title", F.lit(""))), F.lit(16)).alias("key"))


@query(r"SELECT doc_id, regexp_replace(text, '(?i)velmont', '[NAME]', 'g') <> text AS changed, length(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 198) || ' … ' || right(text, 198) END) AS n FROM documents WHERE text IS NOT NULL")
def anonymised_trimmed(spark, sf_dir):
    """Names masked, long texts trimmed in the middle."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", (text.anonymise(F.col("text"), ["velmont"]) != F.col("text")).alias("changed"), F.length(text.middle_trim(F.col("text"), 400)).cast("long").alias("n"))


CLAIMS = f"q AS (SELECT CAST(substr(id, 2) AS INTEGER) AS query_id, unnest({TOKENS.format('title')}) AS token FROM topics), qq AS (SELECT query_id, token, count(*) AS qtf FROM q GROUP BY ALL)"
PASSAGES = f"c AS (SELECT DISTINCT CAST(ref_id AS BIGINT) * 1000 + chunk_id AS pid, text FROM evidence_chunks WHERE text IS NOT NULL), x AS (SELECT pid, max(text) AS text FROM c GROUP BY pid), t AS (SELECT pid, unnest({TOKENS.format('text')}) AS token FROM x), p AS (SELECT pid, token, count(*) AS tf FROM t GROUP BY ALL)"
CANDIDATES = "rare AS (SELECT token FROM p GROUP BY token HAVING count(*) <= 2000), h AS (SELECT query_id, pid, count(*) AS shared FROM qq JOIN rare USING (token) JOIN p USING (token) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, pid) AS rn FROM h)"


def _claims(spark, sf_dir):
    topics = table(spark, sf_dir, "topics", "id", "title").select(F.substring("id", 2, 10).cast("int").alias("q"), "title")
    claims = retrieval.query_tokens(topics, "q", F.col("title"))
    raw = table(spark, sf_dir, "evidence_chunks", "ref_id", "chunk_id", "text").where("text is not null")
    passages = raw.groupBy((F.col("ref_id").cast("long") * 1000 + F.col("chunk_id")).alias("pid")).agg(F.max("text").alias("text"))
    passages = spread_again(passages, raw)
    return claims, retrieval.claim_postings(passages, "pid", F.col("text"), claims)


@query(f"WITH {CLAIMS}, {PASSAGES}, {CANDIDATES} SELECT query_id, pid, shared, CAST(rn AS INTEGER) AS rn FROM k WHERE rn <= 60")
def claim_candidates_top(spark, sf_dir):
    """Sixty passages of each claim by shared tokens."""
    claims, posts = _claims(spark, sf_dir)
    return retrieval.candidates(claims, posts, "pid")


@query(f"""WITH {CLAIMS}, {PASSAGES}, {CANDIDATES}, z AS (SELECT query_id, count(*) AS q FROM qq GROUP BY ALL), l AS (SELECT pid, sum(tf) AS dl FROM p GROUP BY pid),
s AS (SELECT query_id, pid, sum(least(qtf, tf)) AS o, count(*) AS u FROM k JOIN qq USING (query_id) JOIN p USING (pid, token) WHERE rn <= 60 GROUP BY ALL),
f AS (SELECT query_id, pid, o + 4.0 * u / q + 2.0 * u / sqrt(dl) AS score FROM s JOIN z USING (query_id) JOIN l USING (pid))
SELECT query_id, arg_max(pid, struct_pack(s := round(score, 9), p := -pid)) AS pid, round(max(score), 6) AS score FROM f GROUP BY query_id""")
def claim_best_passage(spark, sf_dir):
    """Best passage of each claim."""
    claims, posts = _claims(spark, sf_dir)
    scores = retrieval.lexical_scores(claims, posts, "pid", retrieval.candidates(claims, posts, "pid")).withColumn("score", F.round("score", 9))
    return retrieval.best_passage(scores, "pid").withColumn("score", F.round("score", 6))


@query("""WITH f AS (SELECT tuple_id, any_value(topic_id) AS topic, TRY_CAST(any_value(sents_id) AS INTEGER) AS sent_id, any_value(ents) AS entities FROM feature_bank GROUP BY tuple_id), i AS (SELECT topic, sent_id, coalesce(entities, []) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY topic, sent_id ORDER BY tuple_id) AS r FROM f) WHERE r = 1),
c AS (SELECT ref_id AS sent_id, min(body) AS sentence FROM source_documents WHERE body IS NOT NULL GROUP BY ref_id),
j AS (SELECT i.*, sentence, len(list_filter(entities, lambda e: contains(sentence, e))) AS h FROM i LEFT JOIN c USING (sent_id)),
s AS (SELECT topic, sent_id, entities, CASE WHEN sentence IS NULL THEN 'INDEX_OUT_OF_RANGE' WHEN len(entities) = 0 THEN 'NO_KEYWORDS' WHEN h = len(entities) THEN 'FULL_MATCH' WHEN h > 0 THEN 'PARTIAL_MATCH' ELSE 'NO_MATCH' END AS status FROM j),
e AS (SELECT topic, sent_id, unnest(entities) AS e FROM s WHERE status = 'NO_MATCH'), d AS (SELECT DISTINCT e FROM e WHERE length(e) >= 2), o AS (SELECT e, c.sent_id AS pos FROM d JOIN c ON contains(sentence, e)),
k AS (SELECT topic, e.sent_id, pos, count(*) AS hits FROM e JOIN o USING (e) GROUP BY ALL), b AS (SELECT topic, sent_id, arg_max(pos, struct_pack(h := hits, a := -pos)) AS pos, max(hits) AS hits FROM k GROUP BY ALL)
SELECT topic, s.sent_id, CASE WHEN b.pos <> s.sent_id THEN 'NO_MATCH_BY_INDEX' ELSE status END AS status, CASE WHEN b.pos <> s.sent_id THEN b.pos END AS fallback_id, CASE WHEN b.pos <> s.sent_id THEN b.hits END AS hits FROM s LEFT JOIN b ON b.topic = s.topic AND b.sent_id = s.sent_id""".replace("SELECT topic, s.sent_id, CASE", "SELECT s.topic, s.sent_id, CASE"))
def evidence_match(spark, sf_dir):
    """Items against the sentence they name, with the best other one."""
    from ..operators import evidence

    f = sequence.keep_first(table(spark, sf_dir, "feature_bank", "tuple_id", "topic_id", "sents_id", "ents"), ["tuple_id"], ["topic_id"])
    items = f.select(F.col("topic_id").alias("topic"), F.col("tuple_id").alias("rank"), F.expr("try_cast(sents_id as int)").alias("sent_id"), F.col("ents").alias("entities"))
    corpus = table(spark, sf_dir, "source_documents", "ref_id", "body").where("body is not null").groupBy(F.col("ref_id").alias("sent_id")).agg(F.min("body").alias("sentence"))
    return evidence.match_items(items, corpus)
