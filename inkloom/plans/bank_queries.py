"""Unit banks, references of articles and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import anchors, bank, graph, sequence, stats, text
from ..session import kept
from ..sources import results
from .common import registry, table

QUERIES, SQL, query = registry()
#: DuckDB: one row per unit.
UNITS = "u AS (SELECT DISTINCT tuple_id, topic_id, verb_sense, obj_head, tuple_freq, TRY_CAST(sents_id AS INTEGER) AS sent_id FROM feature_bank)"


def _units(spark, sf_dir) -> DataFrame:
    f = table(spark, sf_dir, "feature_bank", "tuple_id", "topic_id", "verb_sense", "obj_head", "tuple_freq", "sents_id").distinct()
    return f.withColumn("sent_id", F.expr("try_cast(sents_id as int)")).drop("sents_id")


@query(f"WITH {UNITS}, s AS (SELECT tuple_id, min(verb_sense) AS sense FROM u GROUP BY tuple_id HAVING min(verb_sense) IS NOT NULL) SELECT u.tuple_id, u.obj_head, s.sense FROM u JOIN s USING (tuple_id)")
def units_with_sense(spark, sf_dir):
    """Units that have a sense."""
    u = _units(spark, sf_dir)
    senses = u.select(F.col("tuple_id").alias("unit_id"), F.col("verb_sense").alias("sense"))
    return bank.with_senses(u.withColumn("unit_id", F.col("tuple_id")).drop("verb_sense"), senses).select("tuple_id", "obj_head", "sense")


@query(f"WITH {UNITS}, h AS (SELECT obj_head, right(obj_head, 2) AS head, count(*) AS n_units FROM u WHERE obj_head IS NOT NULL GROUP BY obj_head HAVING count(*) >= 5) SELECT tuple_id, head, n_units FROM u LEFT JOIN h USING (obj_head)")
def units_with_head(spark, sf_dir):
    """Units with what is known of their object, null where it is rare."""
    u = _units(spark, sf_dir)
    heads = u.where("obj_head is not null").groupBy("obj_head").agg(F.right("obj_head", F.lit(2)).alias("head"), F.count("*").alias("n_units")).where("n_units >= 5")
    return bank.with_heads(u, heads, "obj_head").select("tuple_id", "head", "n_units")


@query(f"WITH {UNITS}, n AS (SELECT obj_head AS node, list(sent_id) AS s FROM u WHERE obj_head IS NOT NULL AND sent_id IS NOT NULL GROUP BY obj_head), l AS (SELECT DISTINCT node, unnest(s) AS sent_id FROM n) SELECT sent_id, node FROM l WHERE sent_id >= 0")
def sentence_nodes(spark, sf_dir):
    """Nodes of each sentence."""
    nodes = _units(spark, sf_dir).where("obj_head is not null and sent_id is not null").groupBy(F.col("obj_head").alias("node")).agg(F.collect_set("sent_id").alias("s"))
    return bank.node_links(nodes, "node", "s")


@query(f"""WITH {UNITS}, n AS (SELECT obj_head AS node, min(tuple_id) AS first FROM u WHERE obj_head IS NOT NULL GROUP BY obj_head), i AS (SELECT node, row_number() OVER (ORDER BY first, node) - 1 AS id FROM n)
SELECT node, label FROM i JOIN (SELECT vec_id, label FROM embeddings) e ON e.vec_id = i.id""")
def node_rows(spark, sf_dir):
    """The row of a table of vectors at each node's place."""
    nodes = _units(spark, sf_dir).where("obj_head is not null").select(F.col("obj_head").alias("node"), "tuple_id")
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "row")
    return bank.node_vectors(nodes, "node", rows, "tuple_id", "label")


@query("""WITH f AS (SELECT DISTINCT tuple_id, oh_emb FROM feature_bank), g AS (SELECT tuple_id, any_value(oh_emb) AS v FROM f GROUP BY tuple_id)
SELECT tuple_id, CASE WHEN len(v) = 16 THEN round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x)), 4) ELSE 0 END AS square FROM g""")
def zero_filled_views(spark, sf_dir):
    """A view joined to its units, zeros where it is missing."""
    f = table(spark, sf_dir, "feature_bank", "tuple_id", "oh_emb").groupBy("tuple_id").agg(F.any_value("oh_emb").alias("oh_emb"))
    filled = bank.zero_filled(f.select("tuple_id"), f, "tuple_id", "oh_emb", 16)
    return filled.select("tuple_id", F.round(F.aggregate("oh_emb", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("square"))


@query(f"WITH {UNITS}, t AS (SELECT id AS topic_id, domain FROM topics) SELECT tuple_id, domain FROM u LEFT JOIN t USING (topic_id) WHERE domain IS NOT NULL AND upper(domain) <> 'UNKNOWN'")
def gold_labelled_items(spark, sf_dir):
    """Items with their label, unknown ones dropped."""
    labels = table(spark, sf_dir, "topics", "id", "domain").withColumnRenamed("id", "topic_id")
    return bank.gold_items(_units(spark, sf_dir), labels, "topic_id", "domain").select("tuple_id", "domain")


@query(f"""WITH {UNITS}, n AS (SELECT obj_head AS node, topic_id, count(*) AS n FROM u WHERE obj_head IS NOT NULL AND topic_id IS NOT NULL GROUP BY ALL), r AS (SELECT node, topic_id, rank() OVER (PARTITION BY node ORDER BY n DESC) AS r FROM n),
m AS (SELECT node, min(topic_id) AS topic_id FROM r WHERE r = 1 GROUP BY node) SELECT node, domain FROM m JOIN (SELECT id AS topic_id, domain FROM topics) t USING (topic_id)""")
def node_labels(spark, sf_dir):
    """Label of the place a node stands in most often."""
    links = _units(spark, sf_dir).where("obj_head is not null").select(F.col("obj_head").alias("node"), "topic_id")
    types = table(spark, sf_dir, "topics", "id", "domain").withColumnRenamed("id", "topic_id")
    return bank.node_types(links, "node", "topic_id", types, "domain")


@query("WITH e AS (SELECT DISTINCT tuple_id, topic_id, unnest(ents) AS lemma, tuple_freq FROM feature_bank) SELECT topic_id, lemma, CAST(sum(tuple_freq) AS BIGINT) AS weight FROM e WHERE lemma IS NOT NULL GROUP BY ALL")
def entity_weights(spark, sf_dir):
    """Weights of each topic's entities added up."""
    e = table(spark, sf_dir, "feature_bank", "tuple_id", "topic_id", "ents", "tuple_freq").select("tuple_id", "topic_id", F.explode("ents").alias("lemma"), F.col("tuple_freq").alias("weight")).distinct()
    return bank.expansion_sums(e, "topic_id", "lemma", "weight")


@query("""WITH e AS (SELECT tuple_id, any_value(topic_id) AS topic_id, any_value(ents) AS ents FROM feature_bank GROUP BY tuple_id), w AS (SELECT topic_id, unnest(ents) AS lemma, unnest(range(len(ents))) AS rank FROM e)
SELECT topic_id, lemma, round(sum(1 / ln(2 + rank)), 6) AS score FROM w GROUP BY ALL""")
def expansion_scores(spark, sf_dir):
    """Words of a mention scored by their rank, added up by topic."""
    e = table(spark, sf_dir, "feature_bank", "tuple_id", "topic_id", "ents").groupBy("tuple_id").agg(F.any_value("topic_id").alias("topic_id"), F.any_value("ents").alias("ents"))
    w = e.select("topic_id", F.posexplode("ents").alias("rank", "lemma")).withColumn("own", F.lit(None).cast("double"))
    return bank.expansion_scores(w, "topic_id", "lemma", "rank", "own").withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT TRY_CAST(split_part(verb_sense, '.', 2) AS INTEGER) AS n FROM (SELECT DISTINCT tuple_id, verb_sense FROM feature_bank)) SELECT CASE WHEN n IS NULL THEN 'skipped' WHEN n > 0 THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM s GROUP BY 1""".replace("GROUP BY 1", "GROUP BY ALL"))
def sense_outcomes(spark, sf_dir):
    """Outcomes of the choice of senses; number 0 counts as an error."""
    u = table(spark, sf_dir, "feature_bank", "tuple_id", "verb_sense").distinct()
    return bank.outcome_counts(u, bank.sense_outcome(F.expr("try_cast(try_element_at(split(verb_sense, '[.]'), 2) as int)")))


@query("SELECT count(*) FILTER (coalesce(trim(domain), '') <> '') AS classified, count(*) FILTER (coalesce(trim(domain), '') = '') AS unclassified FROM topics")
def classified_topics(spark, sf_dir):
    """Topics with and without a domain."""
    return bank.classified(table(spark, sf_dir, "topics", "domain"), "domain")


@query(f"""WITH {UNITS}, t AS (SELECT obj_head AS term, sum(tuple_freq) AS n FROM u WHERE obj_head IS NOT NULL GROUP BY obj_head), k AS (SELECT * FROM t WHERE term NOT IN (SELECT DISTINCT split_part(verb_sense, '.', 1) FROM u WHERE verb_sense IS NOT NULL) AND NOT starts_with(term, '##'))
SELECT term, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY term) - 1 AS index FROM k""")
def vocabulary_reindexed(spark, sf_dir):
    """Vocabulary without stop words, numbered anew."""
    u = _units(spark, sf_dir)
    terms = u.where("obj_head is not null").groupBy(F.col("obj_head").alias("term")).agg(F.sum("tuple_freq").alias("n"))
    stop = u.where("verb_sense is not null").select(F.element_at(F.split("verb_sense", r"\."), 1).alias("w")).distinct()
    return bank.kept_vocabulary(terms, "term", stop, ["term"])


@query(f"WITH {UNITS}, f AS (SELECT topic_id, min(tuple_id) AS first_at, count(*) AS n FROM u WHERE topic_id IS NOT NULL GROUP BY topic_id) SELECT topic_id, row_number() OVER (ORDER BY first_at, topic_id) - 1 AS code, n FROM f")
def label_codes(spark, sf_dir):
    """Labels numbered by first appearance, with their frequency."""
    return bank.label_codes(_units(spark, sf_dir), "topic_id", "tuple_id").select("topic_id", "code", "n")


@query(f"WITH {UNITS} SELECT verb_sense, obj_head, count(DISTINCT topic_id) AS n_labels FROM u GROUP BY ALL HAVING count(DISTINCT topic_id) > 1")
def relabelled_units(spark, sf_dir):
    """The same unit under different labels."""
    return bank.relabelled(_units(spark, sf_dir), ["verb_sense", "obj_head"], "topic_id")


@query("""WITH a AS (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS key, count(*) AS n FROM supplier GROUP BY ALL) SELECT a.key, a.n AS buyers_n, b.n AS sellers_n FROM a JOIN b USING (key)""")
def equal_key_groups(spark, sf_dir):
    """Two tables of measures that must hold the same keys."""
    a = table(spark, sf_dir, "customer", "c_nationkey").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier", "s_nationkey").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n"))
    shared = a.join(b, "key", "left_semi"), b.join(a, "key", "left_semi")  # small tables may lack a nation
    return results.equal_keys({"buyers": shared[0], "sellers": shared[1]}, "key")


@query("""WITH s AS (SELECT user_id AS doc, event_type AS metric, CASE WHEN value >= 1 THEN value END AS v FROM events), m AS (SELECT doc, metric, avg(v) AS mean FROM s WHERE v IS NOT NULL GROUP BY ALL)
SELECT doc, metric, round(mean, 6) AS mean FROM m UNION ALL SELECT doc, 'overall', round(avg(mean), 6) FROM m GROUP BY doc""")
def document_means(spark, sf_dir):
    """Means per document and metric, missing ones passed over."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value").select(F.col("user_id").alias("doc"), F.col("event_type").alias("metric"), F.when(F.col("value") >= 1, F.col("value")).alias("v"))
    return results.document_means(e, ["doc"], "metric", "v").withColumn("mean", F.round("mean", 6))


@query("""WITH f AS (SELECT DISTINCT tuple_id, topic_id, verb_sense, tuple_freq, coalesce(len(ents), 0) > 0 AS named FROM feature_bank WHERE verb_sense IS NOT NULL AND topic_id IS NOT NULL), a AS (SELECT topic_id, verb_sense AS key, CAST(max(tuple_freq) AS BIGINT) AS value FROM f WHERE NOT named GROUP BY ALL), b AS (SELECT topic_id, verb_sense AS key, CAST(max(tuple_freq) AS BIGINT) AS value FROM f WHERE named GROUP BY ALL)
SELECT topic_id, key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (topic_id, key)""")
def merged_maps(spark, sf_dir):
    """Each topic's map of units without entities merged with that of units with some,
    which wins (U6)."""
    f = table(spark, sf_dir, "feature_bank", "tuple_id", "topic_id", "verb_sense", "tuple_freq", "ents").where("verb_sense is not null and topic_id is not null")
    f = f.withColumn("named", F.coalesce(F.size("ents"), F.lit(0)) > 0)
    g = f.groupBy("topic_id", "verb_sense", "named").agg(F.max("tuple_freq").alias("value"))
    half = lambda named: F.map_from_entries(F.collect_list(F.when(F.col("named") == named, F.struct("verb_sense", "value"))))
    both = g.groupBy("topic_id").agg(half(False).alias("a"), half(True).alias("b"))
    return both.select("topic_id", F.explode(bank.merged(F.col("a"), F.col("b"))).alias("key", "value"))


HEADS = r"h AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS seq, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '^#{1,4} '))"


def _headings(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.where(F.col("line").rlike("^#{1,4} ")).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("seq"), "line")


@query(f"""WITH {HEADS} SELECT doc_id, seq, coalesce(list(line) OVER w, []) AS context_headings, right(coalesce(string_agg(line, chr(10)) OVER w, ''), 1800) AS context_tail FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)""")
def running_contexts(spark, sf_dir):
    """What the writer of each section sees of those before."""
    return sequence.running_context(_headings(spark, sf_dir), "doc_id", "seq", "line", "line").select("doc_id", "seq", "context_headings", "context_tail")


@query(f"WITH {HEADS} SELECT doc_id, seq, CASE WHEN length(line) <= 24 THEN line ELSE left(line, 16) || '…' || right(line, 8) END AS field FROM h WHERE NOT contains(line, '附录') AND NOT contains(line, '参考文献')")
def bounded_headings(spark, sf_dir):
    """Headings without appendices, cut to a budget of head and tail."""
    h = anchors.without_appendix(_headings(spark, sf_dir), "line")
    return h.select("doc_id", "seq", anchors.bounded(F.col("line"), 16, 8).alias("field"))


@query("""WITH s AS (SELECT ref_id, min(title) AS title, min(body) AS body FROM source_documents GROUP BY ref_id) SELECT ref_id, length(CASE WHEN length(title) >= 20 THEN title ELSE coalesce(body, '') END) AS n FROM s""")
def reference_lengths(spark, sf_dir):
    """What a reference list holds of each source (K5), a title of 20 signs for the snippet."""
    s = table(spark, sf_dir, "source_documents", "ref_id", "title", "body").groupBy("ref_id").agg(F.min("title").alias("title"), F.min("body").alias("body"))
    return s.select("ref_id", F.length(results.reference_text(F.col("title"), F.col("body"), 20)).cast("long").alias("n"))


@query(r"""WITH c AS (SELECT doc_id, topic_id, list_transform(regexp_extract_all(text, '\[\^(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS ids FROM documents WHERE text IS NOT NULL), e AS (SELECT DISTINCT doc_id, unnest(ids) AS id FROM c), m AS (SELECT DISTINCT ref_id AS id, ref_id * 10 AS a, ref_id * 10 + 1 AS b FROM source_documents),
x AS (SELECT doc_id, unnest([a, b]) AS r FROM e JOIN m USING (id)) SELECT c.doc_id, coalesce((SELECT list_sort(list(DISTINCT r)) FROM x WHERE x.doc_id = c.doc_id), []) AS refs FROM (SELECT DISTINCT doc_id FROM c) c""")
def real_reference_ids(spark, sf_dir):
    """Placeholders of a text as the ids they stand for, in order."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").withColumn("p", text.citation_ids(F.col("text")))
    known = table(spark, sf_dir, "source_documents", "ref_id").distinct().select(F.col("ref_id").alias("placeholder"), F.array(F.col("ref_id") * 10, F.col("ref_id") * 10 + 1).alias("ids"))
    return anchors.resolved_ids(d, "doc_id", "p", known)


@query(r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[\^(\d+)\]', 1))::INTEGER AS id FROM d), n AS (SELECT doc_id, id, count(*) AS n FROM i GROUP BY ALL),
t AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS uniq, max(n) / sum(n) AS ratio, count(*) FILTER (id NOT IN (SELECT ref_id FROM evidence_chunks WHERE ref_id IS NOT NULL)) AS n_invalid FROM n GROUP BY doc_id)
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, coalesce(total, 0) AS total, coalesce(uniq, 0) AS uniq, round(coalesce(ratio, 0), 6) AS ratio, coalesce(n_invalid, 0) AS n_invalid FROM d LEFT JOIN t USING (doc_id)""")
def evidence_packages(spark, sf_dir):
    """Statistics of each article's evidence."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").distinct()
    refs = table(spark, sf_dir, "evidence_chunks", "ref_id").distinct()
    return anchors.package(d, "doc_id", "text", refs, "ref_id").select("doc_id", F.col("chars").cast("long").alias("chars"), "total", "uniq", F.round("ratio", 6).alias("ratio"), "n_invalid")


def _segments(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(titles of the sources as claims on them, evidence chunks as passages), each with
    the topic that bounds what they may meet."""
    owner = table(spark, sf_dir, "source_documents", "ref_id", "topic_id", "title").groupBy("ref_id").agg(F.min("topic_id").alias("topic"), F.min("title").alias("title"))
    seg = owner.where("title is not null").select(F.col("ref_id").cast("long").alias("seg"), F.col("ref_id").alias("ref"), F.col("title").alias("text"), "topic")
    # one shuffle of the texts for the repeated rows and for the topic
    chunks = table(spark, sf_dir, "evidence_chunks", "ref_id", "chunk_id", "text").where("text is not null").repartition("ref_id").groupBy("ref_id", "chunk_id").agg(F.max("text").alias("text"))
    pid = F.col("ref_id").cast("long") * (1 << 20) + F.col("chunk_id")
    return seg, chunks.select(pid.alias("pid"), F.col("ref_id").alias("ref"), "text").join(owner.select(F.col("ref_id").alias("ref"), "topic"), "ref")


@query()
def rebound_citations(spark, sf_dir):
    """Each source's title bound to a passage (H1)."""
    seg, passages = _segments(spark, sf_dir)
    return anchors.rebound(seg, passages, "topic")


@query()
def grounded_titles(spark, sf_dir):
    """The same without a citation (H2)."""
    seg, passages = _segments(spark, sf_dir)
    return anchors.grounded_segments(seg.drop("ref"), passages, "topic")


@query()
def collapsed_sources(spark, sf_dir):
    """One reference a source out of the bound passages."""
    seg, passages = _segments(spark, sf_dir)
    passages = kept(passages, "passages")
    return anchors.by_source(anchors.rebound(seg, passages, "topic"), passages)


@query(f"""WITH u AS (SELECT DISTINCT tuple_id, TRY_CAST(sents_id AS INTEGER) AS sent_id, verb_sense AS verb, obj_head AS object, ents FROM feature_bank WHERE verb_sense IS NOT NULL), o AS (SELECT verb AS src, object AS dst FROM u WHERE object IS NOT NULL),
n AS (SELECT sent_id, verb, unnest(ents) AS dst FROM u), e AS (SELECT min(verb) AS src, dst FROM n WHERE dst IS NOT NULL GROUP BY sent_id, dst) SELECT DISTINCT src, dst, CAST(9 AS DOUBLE) AS weight FROM (SELECT * FROM o UNION ALL SELECT src, dst FROM e) WHERE src <> dst""")
def evidence_edges(spark, sf_dir):
    """Edges of verbs to objects and entities, an entity once a sentence."""
    u = table(spark, sf_dir, "feature_bank", "tuple_id", "sents_id", "verb_sense", "obj_head", "ents").select(F.expr("try_cast(sents_id as int)").alias("sent_id"), F.col("verb_sense").alias("verb"), F.col("obj_head").alias("object"), F.col("ents").alias("entities"))
    return graph.evidence_edges(u)


@query(f"WITH {UNITS}, p AS (SELECT DISTINCT least(verb_sense, obj_head) AS a, greatest(verb_sense, obj_head) AS b FROM u WHERE verb_sense <> obj_head), d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY node) SELECT count(*) AS nodes, CAST(coalesce(sum(d), 0) // 2 AS BIGINT) AS edges, round(avg(d), 6) AS average FROM d")
def average_degree(spark, sf_dir):
    """Average degree of the graph of units."""
    pairs = graph.undirected(_units(spark, sf_dir).where("verb_sense is not null and obj_head is not null").select(F.col("verb_sense").alias("src"), F.col("obj_head").alias("dst")))
    return graph.average_degree(pairs).withColumn("average", F.round("average", 6))


@query(f"""WITH {UNITS}, v AS (SELECT topic_id, verb_sense FROM u WHERE verb_sense IS NOT NULL GROUP BY ALL HAVING sum(tuple_freq) >= 4), o AS (SELECT topic_id, obj_head FROM u WHERE obj_head IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
f AS (SELECT tuple_id, v.verb_sense IS NOT NULL AS a, o.obj_head IS NOT NULL AS b FROM u LEFT JOIN v USING (topic_id, verb_sense) LEFT JOIN o USING (topic_id, obj_head)) SELECT tuple_id, a AND b AS all_salient FROM f WHERE a OR b""")
def units_with_salient_part(spark, sf_dir):
    """Units with a salient verb or object, and whether both are."""
    u = _units(spark, sf_dir)
    verbs = u.where("verb_sense is not null").groupBy("topic_id", "verb_sense").agg(F.sum("tuple_freq").alias("n")).where("n >= 4")
    objects = u.where("obj_head is not null").groupBy("topic_id", "obj_head").agg(F.count("*").alias("n")).where("n >= 3")
    return graph.salience_flags(u, "topic_id", {"verb_sense": verbs, "obj_head": objects}).select("tuple_id", "all_salient")


@query(rf"""WITH {HEADS}, s AS (SELECT source, doc_id, seq, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_replace(line, '^#+\s*', '') AS title FROM h JOIN (SELECT DISTINCT doc_id, source FROM documents WHERE source IS NOT NULL) d USING (doc_id)),
t AS (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY source ORDER BY doc_id, seq) AS top FROM s) SELECT source, doc_id, seq, CASE WHEN level = 1 THEN CAST(top AS VARCHAR) WHEN level = 2 THEN top || '.' || count(*) FILTER (level = 2) OVER (PARTITION BY source, top ORDER BY doc_id, seq) END AS number FROM t""")
def outlines_merged(spark, sf_dir):
    """Outlines of a source's documents as one, numbered through (K4)."""
    from ..operators import contents

    d = table(spark, sf_dir, "documents", "doc_id", "source").where("source is not null").distinct()
    parts = _headings(spark, sf_dir).join(d, "doc_id").withColumn("level", F.length(F.regexp_extract("line", "^(#+)", 1)))
    return contents.renumbered(parts, "source", ["doc_id", "seq"]).select("source", "doc_id", "seq", "number")


@query(r"""WITH u AS (SELECT DISTINCT topic_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '/+$', '') AS u FROM search_results WHERE url IS NOT NULL AND url <> '' AND topic_id IS NOT NULL), r AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://', ''), '/+$', '') AS u, ref_id AS id FROM source_documents WHERE url IS NOT NULL AND url <> '')
SELECT topic_id, list_sort(list(DISTINCT id)) AS ids FROM u JOIN r USING (u) GROUP BY topic_id""")
def topic_reference_ids(spark, sf_dir):
    """Ids of the sources that a topic's found addresses name."""
    found = table(spark, sf_dir, "search_results", "topic_id", "url").where("topic_id is not null").withColumn("urls", F.array("url"))
    refs = table(spark, sf_dir, "source_documents", "ref_id", "url").select("url", F.col("ref_id").alias("id"))
    return sequence.ids_of_urls(found, "topic_id", "urls", refs)


@query("""WITH f AS (SELECT tuple_id, any_value(ents) AS ents, any_value(obj_head) AS obj_head FROM feature_bank GROUP BY tuple_id), l AS (SELECT tuple_id, list_concat(CASE WHEN obj_head IS NULL THEN [] ELSE [obj_head] END, coalesce(ents, []), coalesce(ents, [])) AS l FROM f)
SELECT tuple_id, coalesce(list_transform(list_filter(list_zip(l, range(len(l))), lambda x: list_position(l, x[1]) = x[2] + 1), lambda x: x[1]), []) AS names FROM l""")
def names_of_units(spark, sf_dir):
    """Object and entities of a unit, each once, in order."""
    f = table(spark, sf_dir, "feature_bank", "tuple_id", "ents", "obj_head").groupBy("tuple_id").agg(F.any_value("ents").alias("ents"), F.any_value("obj_head").alias("obj_head"))
    own = F.when(F.col("obj_head").isNotNull(), F.array("obj_head"))
    return f.select("tuple_id", text.ordered_union(own, F.col("ents"), F.col("ents")).alias("names"))


SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"SELECT DISTINCT id, length(regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g')) >= 50 AS long_enough FROM search_results WHERE content IS NOT NULL")
def long_pages(spark, sf_dir):
    """Pages with enough text to be read."""
    return table(spark, sf_dir, "search_results", "id", "content").where("content is not null").select("id", text.long_enough(F.col("content")).alias("long_enough")).distinct()


@query(r"""WITH t AS (SELECT id AS topic_id, lower(title) AS core FROM topics), c AS (SELECT topic_id, replace(replace(replace(replace(replace(replace(replace(replace(core, '技术白皮书', ''), '白皮书', ''), '技术', ''), '发展', ''), '研究', ''), '系统', ''), '平台', ''), '方案', '') AS core FROM t),
a AS (SELECT topic_id, list_distinct(list_concat(regexp_extract_all(core, '[a-z][a-z0-9+.\-]{2,}'), flatten(list_transform(regexp_extract_all(core, '[\x{4e00}-\x{9fff}]+'), lambda r: CASE WHEN length(r) <= 3 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i:i + 1]) END)))) AS a FROM c),
s AS (SELECT DISTINCT ref_id, topic_id, lower(body) AS body FROM source_documents WHERE body IS NOT NULL), j AS (SELECT ref_id, s.topic_id, a, list_filter(a, lambda x: contains(body, x)) AS h FROM s JOIN a USING (topic_id))
SELECT ref_id, topic_id, bool_or(CASE WHEN len(a) = 0 THEN true WHEN len(list_filter(a, lambda x: regexp_matches(x, '^[a-z]'))) > 0 THEN len(list_filter(h, lambda x: regexp_matches(x, '^[a-z]'))) > 0 ELSE len(h) >= CASE WHEN len(a) <= 2 THEN 1 ELSE 2 END END) AS relevant FROM j GROUP BY ALL""")
def relevant_sources(spark, sf_dir):
    """Sources that speak of their topic by its anchors."""
    topics = table(spark, sf_dir, "topics", "id", "title").select(F.col("id").alias("topic_id"), text.anchors(F.col("title")).alias("a"))
    s = table(spark, sf_dir, "source_documents", "ref_id", "topic_id", "body").where("body is not null").join(topics, "topic_id")
    return s.groupBy("ref_id", "topic_id").agg(F.bool_or(text.is_relevant(F.col("a"), F.col("body"))).alias("relevant"))


@query("""WITH m AS (SELECT l_orderkey AS book, max(l_linenumber) AS longest FROM lineitem GROUP BY book), p AS (SELECT book, l_returnflag AS category, avg(l_linenumber / longest) AS at_, count(*) AS n FROM lineitem JOIN m ON book = l_orderkey GROUP BY ALL)
SELECT category, count(*) AS books, round(avg(at_), 6) AS mean_at, round(quantile_cont(at_, 0.5), 6) AS median_at, round(quantile_cont(at_, 0.9), 6) AS p90_at, round(avg(n), 6) AS mean_n FROM p GROUP BY category""")
def category_place_stats(spark, sf_dir):
    """Where a category stands in its books, over books."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber").select(F.col("l_orderkey").alias("book"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("seq"))
    return stats.category_stats(l, "book", "category", "seq").select("category", "books", *(F.round(c, 6).alias(c) for c in ("mean_at", "median_at", "p90_at", "mean_n")))


@query("""WITH d AS (SELECT DISTINCT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, n, greatest(0, CAST(ceil((n - 510) / 255.0) AS INTEGER)) AS last FROM d)
SELECT doc_id, last + 1 AS windows, CAST(last * 255 AS INTEGER) AS last_start, CAST(least(n, last * 255 + 510) AS INTEGER) AS last_end, CAST(least(last, n // 2 // 255) AS INTEGER) AS middle FROM w""")
def overlapping_windows(spark, sf_dir):
    """Windows over each text's places, and the one that holds its middle."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.length("text").alias("n")).distinct()
    w = d.withColumn("w", text.token_windows(F.col("n")))
    last = F.element_at("w", -1)
    return w.select("doc_id", F.size("w").alias("windows"), last["start"].alias("last_start"), last["end"].alias("last_end"), text.window_of(F.col("n"), F.floor(F.col("n") / 2))["window"].alias("middle"))


@query("""WITH e AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM e), c AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY ALL), k AS (SELECT label AS cluster, list(m ORDER BY pos) AS c FROM c GROUP BY label),
w AS (SELECT vec_id, cluster, 1 / (1 + list_distance(v, c) ** 2) AS w FROM e, k) SELECT vec_id, cluster, round(w / sum(w) OVER (PARTITION BY vec_id), 5) AS p FROM w""")
def student_t_plain(spark, sf_dir):
    """Soft shares over plain distances, as the two-view baseline has them."""
    from ..operators import vectors

    e = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").dropDuplicates(["vec_id"])
    centres = vectors.as_arrays(vectors.mean_vectors(e, "label", "embedding"), "label", "centre").withColumnRenamed("label", "cluster")
    soft = vectors.soft_arrays(e, "vec_id", "embedding", centres, normalise=False).select("vec_id", F.inline("soft"))
    return soft.select("vec_id", "cluster", F.round("p", 5).alias("p"))


@query("""WITH d AS (SELECT DISTINCT topic_id, search_query, id FROM search_results WHERE topic_id IS NOT NULL AND search_query IS NOT NULL), n AS (SELECT topic_id, search_query, count(*) AS n FROM d GROUP BY ALL),
o AS (SELECT topic_id, search_query, coalesce(sum(n) OVER (PARTITION BY topic_id ORDER BY search_query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM n)
SELECT d.topic_id, d.search_query, d.id AS result, CAST(before_ + row_number() OVER (PARTITION BY d.topic_id, d.search_query ORDER BY d.id) AS BIGINT) AS id FROM d JOIN o ON o.topic_id = d.topic_id AND o.search_query = d.search_query""")
def result_numbers(spark, sf_dir):
    """Results of a topic's queries numbered through."""
    d = table(spark, sf_dir, "search_results", "topic_id", "search_query", "id").where("topic_id is not null and search_query is not null").distinct().withColumnRenamed("id", "result")
    return sequence.offset_ids(d, "topic_id", ["search_query"], "result").select("topic_id", "search_query", "result", "id")
