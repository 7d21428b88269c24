"""Core operators on small fixtures: hand-computed values and plain-Python restatements."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.functions import services, sql
from inkloom.operators import citations, graph, retrieval, sequence, stats, text, units, vectors
from inkloom.sources import readers
from inkloom.streaming import windows


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("v")), "MQTT v5.0 区块链 a 网") == ["mqtt", "v5.0", "网", "区块", "块链", "区块链"]
    assert one(spark, text.tokens(F.col("v")), "") == []
    for v in ("MQTT v5.0 区块链 a 网", "", "的", "一二", "一二三四 x yz"):
        assert one(spark, text.token_count(F.col("v")), v) == len(one(spark, text.tokens(F.col("v")), v))
    assert one(spark, text.tokens(F.col("v")), None) is None


@pytest.mark.parametrize("value,want", [("9", []), ("10", ["10"]), ("3.5", ["3.5"]), ("20%", ["20%"]), ("20％", ["20%"]), ("5~8ms", ["5~8ms"]), ("A12", []), ("5GB 和 7", ["5gb"]), (None, None)])
def test_numbers(spark, value, want):
    assert one(spark, text.numeric_values(F.col("v")), value) == want


def test_line_cleaner(spark):
    keep = "这是一个用来测试清洗规则的完整中文句子没有问题"
    body = "\n".join([keep, "短句", "1、" + keep, "12.34.56.78.90.12.34.56", "This line is plain English text only", "", "   "])
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, t string")
    assert [r.line for r in text.clean_lines(df, "id", "t").collect()] == [keep, keep]
    assert [r.line for r in text.clean_lines(df, "id", "t", "latin").collect()] == ["This line is plain English text only"]


def test_small_text_functions(spark):
    assert one(spark, text.safe_name(F.col("v")), '  a/b:"c"\t d ') == "a_b__c__ d"
    assert one(spark, text.safe_name(F.col("v")), None) == "untitled"
    assert one(spark, text.canonical(F.col("v")), "Ｖelmont 白皮书-1!") == "velmont白皮书1"
    assert one(spark, text.clean_title(F.col("v")), "## 1.2 Title") == "Title"
    assert one(spark, text.tagged(F.col("v"), "search"), "<search>a\nb</search><SEARCH>c</SEARCH>") == ["a\nb", "c"]
    assert one(spark, text.char_jaccard(F.col("v"), F.lit("abc")), "abd") == 0.5
    assert one(spark, text.host(F.col("v")), "HTTPS://www.A.example:8/x") == "a.example"
    assert one(spark, text.middle_trim(F.col("v"), 7), "abcdefghij") == "ab … ij"
    assert one(spark, text.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))), [1.0, 2.0], "array<double>") == 0.0


def test_keep_first_and_ties(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 5, "n")], "k string, pos int, _row string")
    got = {(r.k, r.pos, r._row) for r in sequence.keep_first(df.withColumnRenamed("_row", "v"), ["k"], ["pos"]).withColumnRenamed("v", "_row").collect()}
    assert got == {("a", 1, "y"), ("b", 1, "z"), (None, 5, "n")}


def test_heading_parents(spark):
    df = spark.createDataFrame([(1, i, lv) for i, lv in enumerate([1, 3, 2, 3, 1, 2], 1)], "d int, seq int, level int")
    got = {r.seq: r.parent_seq for r in sequence.heading_parents(df, "d", "seq", "level").collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 3, 5: None, 6: 5}


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "n string, p double")
    got = {r.n: round(r.p_holm, 9) for r in sequence.holm(df, "p", ["n"]).collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


def test_dense_ids(spark):
    df = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", 1)], "k string, p int")
    assert {r.k: r.id for r in sequence.dense_ids(df, "k", "p").collect()} == {"c": 0, "b": 1, "a": 2}


def packed(body, target=900, least=30, least_slice=80):
    """Plain restatement of the paragraph packer."""
    ps = [re.sub("[​﻿]", "", re.sub(r"\s+", " ", p)).strip() for p in re.split(r"\n\s*\n|(?=^#{1,4}\s)", body, flags=re.M)]
    out, held, size = [], [], 0
    for p in (p for p in ps if len(p) >= least):
        if held and size + len(p) > target:
            out.append("\n".join(held))
            held, size = [], 0
        if len(p) > 2 * target:
            out += [s for s in (p[i : i + target] for i in range(0, len(p), target)) if len(s) >= least_slice]
            continue
        held.append(p)
        size += len(p)
    return out + (["\n".join(held)] if held else [])


def test_packer_equals_restatement(spark):
    rng = random.Random(4)
    bodies = ["\n\n".join("w" * rng.choice([10, 40, 300, 700, 2000, 1850]) for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["", None, "# Kopf\n" + "x" * 50]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, t string")
    got = {}
    for r in retrieval.packed_paragraphs(df, "id", "t").orderBy("id", "chunk_id").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert got == {i: c for i, b in enumerate(bodies) if b and (c := packed(b))}


def test_budgeted_selection_equals_restatement(spark):
    rng = random.Random(9)
    data = [(g, i, rng.randint(0, 8), rng.choice([500, 3000, 9000]), float(rng.randint(-1, 5))) for g in range(6) for i in range(40)]
    df = spark.createDataFrame(data, "g int, at int, src int, size int, score double")
    got = {}
    for r in retrieval.select_within_budget(df, "g", "at", "src", "size").orderBy("g", "taken").collect():
        got.setdefault(r.g, []).append(r.at)
    want = {}
    for g in range(6):
        used, total = Counter(), 0
        for _, at, src, size, score in sorted((d for d in data if d[0] == g), key=lambda d: (-d[4], d[1])):
            if score <= 0 or len(want.get(g, [])) >= 12:
                break
            if used[src] >= 2 or want.get(g) and total + size > 14500:
                continue
            want.setdefault(g, []).append(at)
            used[src] += 1
            total += size
    assert got == want


def test_bm25_equals_formula(spark):
    docs = {1: "alpha beta beta", 2: "beta gamma", 3: "delta", 4: None}
    df = spark.createDataFrame(list(docs.items()), "id int, t string")
    docs_ = retrieval.arrays(df, ["id"], F.col("t"))
    asked = spark.createDataFrame([(1, "beta", 3), (1, "gamma", 1)], "query_id int, token string, qtf int")
    got = {r.id: r.score for r in retrieval.bm25(docs_, ["id"], asked).collect()}
    n, avg = 3, 2.0
    idf = lambda d: math.log(1 + (n - d + 0.5) / (d + 0.5))
    part = lambda tf, dl: tf * 2.35 / (tf + 1.35 * (0.28 + 0.72 * dl / avg))
    assert got[1] == pytest.approx(idf(2) * part(2, 3) * 2)
    assert got[2] == pytest.approx(idf(2) * part(1, 2) * 2 + idf(1) * part(1, 2))
    assert retrieval.bm25(docs_.where("false"), ["id"], asked).count() == 0


def test_candidates_count_frequent_tokens(spark):
    posts = spark.range(2500).select(F.explode(F.array(F.struct(F.col("id").alias("pid"), F.lit("often").alias("token")), F.struct(F.when(F.col("id") == 2400, F.col("id")).alias("pid"), F.lit("seldom").alias("token")))).alias("p")).select("p.*").where("pid is not null")
    claims = spark.createDataFrame([(1, "often", 1), (1, "seldom", 1), (2, "often", 1)], "query_id int, token string, qtf int")
    got = {(r.query_id, r.rn): (r.pid, r.shared) for r in retrieval.candidates(claims, posts, "pid").collect()}
    assert len(got) == 120 and got[1, 1] == (2400, 2) and got[1, 2] == (0, 1) and got[2, 60] == (59, 1)


def test_recursive_chunks(spark):
    df = spark.createDataFrame([(1, "ab cd. " * 100), (2, "x" * 400), (3, ""), (4, None)], "id int, t string")
    got = retrieval.recursive_chunks(df, "id", "t").collect()
    assert all(len(r.chunk) <= 150 for r in got) and {r.id for r in got} == {1, 2}
    assert retrieval.overlapping_windows(1000) == [(0, 510), (255, 765), (510, 1000)]


def test_external_measures(spark):
    table = lambda pairs: spark.createDataFrame([(a, b, n) for (a, b), n in Counter(pairs).items()], "label int, cluster int, n long")
    same = stats.external_measures(table([(i % 3, 7 - i % 3) for i in range(30)])).first()
    assert [round(v, 6) for v in same] == [100.0] * 5
    y, c = [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2]
    m = stats.external_measures(table(list(zip(y, c)))).first()
    assert m.ari == pytest.approx(24.242424, abs=1e-4)
    assert stats.accuracy(table(list(zip(y, c)))) == pytest.approx(100 * 4 / 6)


def test_hungarian_against_permutations():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n in range(1, 6):
        m = rng.integers(0, 20, (n, n)).astype(float)
        got = sum(m[i, j] for i, j in enumerate(stats.hungarian(m)))
        assert got == min(sum(m[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_paired_tests():
    a, b = np.array([4.1, 4.4, 3.9, 4.8, 4.2, 4.0]), np.array([4.0, 4.1, 3.9, 4.2, 4.3, 3.5])
    stat, p = stats.wilcoxon(a, b)
    assert stat == 1.5 and 0.05 < p < 0.2
    assert stats.wilcoxon(a, a) == (0.0, 1.0)
    low, high = stats.paired_bootstrap(a - b)
    assert low < (a - b).mean() < high


def test_silhouette_of_more_than_two_thousand(spark, tmp_path):
    from inkloom.plans import cluster_queries

    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(2300, 3)), rng.integers(0, 3, 2300)
    x[np.arange(2300), c] += 2
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))], "vec_id long, embedding array<double>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.s for r in cluster_queries.silhouette_sampled(spark, str(tmp_path)).collect()}
    assert len(got) == 2300
    for i in (0, 7, 2299):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        a, b = d[c == c[i]].sum() / ((c == c[i]).sum() - 1), min(d[c == k].mean() for k in range(3) if k != c[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_self_training_tells_where_it_did_not_settle(spark, monkeypatch):
    import inspect

    from inkloom.operators import vectors
    from inkloom.plans import cluster_queries

    df = spark.createDataFrame([(i, [1.0, i / 40]) for i in range(40)], "id int, v array<double>")
    start = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "cluster int, centre array<double>")
    with pytest.warns(UserWarning, match="still moved"):
        assert vectors.self_train(df, "id", "v", start, rounds=1).count() == 40
    asked, held = {}, inspect.signature(vectors.self_train)
    monkeypatch.setattr(vectors, "self_train", lambda *a, **k: asked.update(held.bind(*a, **k).arguments) or a[0])
    cluster_queries.self_trained_clusters(spark, "/root/testdata/sf0.001")
    given = {k: asked.get(k, held.parameters[k].default) for k in ("rounds", "tolerance")}
    assert given["rounds"] >= 50 and given["tolerance"] == 0.001


def test_significance_and_kmeans_take_the_reference_numbers(spark, monkeypatch):
    from inkloom.operators import vectors
    from inkloom.plans import cluster_queries, score_queries

    data = "/root/testdata/sf0.001"
    v = stats.valid_scores(score_queries._event_scores(spark, data)).groupBy("topic", "method").agg(F.avg("score").alias("v")).toPandas().pivot(index="topic", columns="method", values="v").sort_index()
    r = score_queries.method_significance(spark, data).first()
    pair = v[[r.a, r.b]].dropna()
    assert (r.low, r.high) == pytest.approx(stats.paired_bootstrap((pair[r.a] - pair[r.b]).to_numpy(), 10000))
    asked = {}
    monkeypatch.setattr(vectors, "spherical_kmeans", lambda *a, **k: asked.update(k))
    cluster_queries.kmeans_spherical(spark, data)
    assert asked["runs"] == 5


def test_summary_reproduces_published_deviation(spark):
    """Mean and sample deviation of ten published-style values."""
    v = [48.1, 50.2, 52.9, 49.5, 51.3, 47.7, 53.0, 50.8, 52.4, 49.58]
    df = spark.createDataFrame([("m", x) for x in v] + [("one", 1.0)], "k string, score double")
    got = {r.k: (r.mean, r.std) for r in stats.means(df, ["k"]).collect()}
    assert got["m"] == pytest.approx((np.mean(v), np.std(v, ddof=1))) and got["one"] == (1.0, 0.0)


def test_signed_ranks_against_the_plain_form(spark):
    rng = np.random.default_rng(5)
    d = np.round(rng.normal(0.1, 1, 60), 1)
    df = spark.createDataFrame([("x", float(v)) for v in d] + [("zero", 0.0)], "k string, d double")
    r = stats.signed_ranks(df, ["k"], "d").withColumn("p", stats.two_sided(F.col("z"))).collect()
    stat, p = stats.wilcoxon(d, np.zeros(60))
    assert len(r) == 1 and r[0].w == stat and r[0].p == pytest.approx(p)


def test_means_of_ragged_and_missing_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0]), ("a", None), ("b", []), ("a", [5.0, None])], "k string, v array<float>")
    got = {(r.k, r.pos): r.value for r in vectors.mean_vectors(df, "k", "v").collect()}
    assert got == {("a", 0): 3.0, ("a", 1): 2.0}


def test_soft_assignment_sums_to_one(spark):
    df = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(12)] + [(99, [0.0, 0.0])], "id int, v array<double>")
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, centre array<double>")
    soft = vectors.target(vectors.student_t(df, "id", "v", centres), "id")
    sums = soft.groupBy("id").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()
    assert all(abs(r.p - 1) < 1e-9 and abs(r.q - 1) < 1e-9 for r in sums)
    assert {r.id: r.cluster for r in vectors.assign(df, "id", "v", centres).collect()}[99] == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "src string, dst string")
    p = graph.undirected(e)
    assert {(r.a, r.b) for r in p.collect()} == {("a", "b"), ("b", "c")}
    assert {r.node: r.degree for r in graph.degrees(p).collect()} == {"a": 1, "b": 2, "c": 1}
    w = {(r.src, r.dst): r.w for r in graph.normalised(p).collect()}
    assert w["a", "b"] == pytest.approx(1 / math.sqrt(6)) and w["b", "b"] == pytest.approx(1 / 3)


def test_salience(spark):
    local = spark.createDataFrame([("t", "a", 5), ("t", "'b'", 4), ("t", "c", 9), ("t", "stop", 50)], "g string, term string, local long")
    world = spark.createDataFrame([("a", 100), ("b", 1000), ("stop", 10)], "term string, freq long")
    s = graph.salience(local, world)
    assert {r.term: (r["global"], round(r.salience, 6)) for r in s.collect()} == {"a": (100, 10.0), "'b'": (1000, 12.0), "c": (-1, 0.0), "stop": (10, 50.0)}
    kept = graph.top_ratio(s, "g", spark.createDataFrame([("stop",)], "term string"))
    assert [r.term for r in kept.orderBy(F.desc("salience")).collect()] == ["'b'", "a"]


def test_citations(spark):
    body = "# Kopf\nEin Absatz, der lang genug ist, um als Absatz zu zählen, wirklich.[^3][^3][^1]\n\nNoch ein Absatz ohne Beleg, auch er ist lang genug für die Zählung.\n\n| a | b |\n\nkurz"
    df = spark.createDataFrame([(1, body), (2, "nichts")], "id int, t string")
    d = citations.distribution(df, "id", "t").collect()
    assert [(r.id, r.total, r.uniq, r.dominant, round(r.ratio, 4)) for r in d] == [(1, 3, 2, 3, 0.6667)]
    assert {r.id: r.coverage for r in citations.paragraph_coverage(df, "id", "t").collect()} == {1: 0.5, 2: 0.0}
    refs = spark.createDataFrame([(3,)], "r int")
    assert [(r.id, r.cited) for r in citations.invalid(df, "id", "t", refs, "r").collect()] == [(1, 1)]
    claims = spark.createDataFrame([(1, 7, "覆盖 120 公里"), (2, 7, "占 35%")], "claim_id int, ref int, text string")
    evidence = spark.createDataFrame([(7, "共 120 公里"), (7, "none")], "ref int, text string")
    assert [(r.claim_id, r.value) for r in citations.unsupported_numbers(claims, evidence).collect()] == [(2, "35%")]
    assert one(spark, citations.drift_ok(F.col("v"), F.lit("abcdef[^1]")), "abcdeg[^1]") is True
    assert one(spark, citations.drift_ok(F.col("v"), F.lit("abcdef[^2]")), "abcdeg[^1]") is False


def tok(rows):
    return [units.Token(*r) for r in rows]


def test_units():
    active = tok([(0, "Teams", "team", "NOUN", "nsubj", 1), (1, "build", "build", "VERB", "ROOT", 1), (2, "fast", "fast", "ADJ", "amod", 3), (3, "grids", "grid", "NOUN", "dobj", 1), (4, "and", "and", "CCONJ", "cc", 3), (5, "nodes", "node", "NOUN", "conj", 3)])
    got = units.Sentence(active).units()
    assert [(u.subject[0], u.verb, u.object[0]) for u in got] == [("Teams", "build", "fast grids"), ("Teams", "build", "nodes")]
    passive = tok([(0, "Grids", "grid", "NOUN", "nsubjpass", 3), (1, "were", "be", "AUX", "auxpass", 3), (2, "not", "not", "PART", "neg", 3), (3, "built", "build", "VERB", "ROOT", 3), (4, "by", "by", "ADP", "agent", 3), (5, "teams", "team", "NOUN", "pobj", 4)])
    assert [(u.subject[0], u.verb, u.object[0]) for u in units.Sentence(passive).units()] == [("teams", "!build", "Grids")]
    assert units.Sentence(active).head((2, 3)) == "grid"


def test_units_table(spark):
    df = spark.createDataFrame([(1, 0, "Teams", "team", "NOUN", "nsubj", 1), (1, 1, "build", "build", "VERB", "ROOT", 1), (1, 2, "grids", "grid", "NOUN", "dobj", 1)], "sent_id long, i int, text string, lemma string, pos string, dep string, head int")
    assert [tuple(r) for r in units.extract_units(df).collect()] == [(1, 0, "Teams", "build", False, "grids", "grid")]


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Titel\n\n  padded \n# note\n", encoding="utf-8")
    assert [r.topic for r in readers.topic_lines(spark, str(tmp_path / "t.txt")).collect()] == ["Titel", "padded"]
    assert readers.topic_lines(spark, str(tmp_path / "t.txt"), False).count() == 3
    assert [(r.sent_id, r.sentence) for r in readers.corpus_lines(spark, str(tmp_path / "t.txt")).orderBy("sent_id").collect()] == [(0, "Titel"), (1, "padded"), (2, "# note")]
    report = "头\n[文章 1] 甲 [tavily]\nURL: http://a.example/1\n正文：内容一\n[文章 2] 乙 [jina]\nURL: http://b.example\n正文：抓取失败\n[文章 3] 丙\nURL: \n正文：内容三\n"
    df = spark.createDataFrame([("p", report)], "path string, value string")
    assert [(r.ref_id, r.title, r.source, r.url, r.body) for r in readers.collector_report(df).orderBy("ref_id").collect()] == [(1, "甲", "tavily", "http://a.example/1", "内容一"), (2, "丙", "", "", "内容三")]
    listing = spark.createDataFrame([("Topic 3 (12): 1/build.0/grid/Velmont[ORG]/x[LOC]/7, 2/a/9, 3/b/c/zz",)], "value string")
    assert [(r.topic_no, r.freq, r.verb, r.entities, r.sent_id) for r in readers.cluster_listing(listing).collect()] == [(3, 12, "build.0", ["Velmont"], 7), (3, 12, "a", [], 9)]
    report = spark.createDataFrame([("Topic 1 x\n[sent_id=4] [FULL] 句子一\n[备选] 不算\nTopic 2\n [sent_id=5] 句子二",), ("[sent_id=6] 无题",)], "value string")
    assert {tuple(r) for r in readers.matched_sentences(report).collect()} == {("Topic 1", "句子一"), ("Topic 2", "句子二"), (None, "无题")}
    senses = spark.createDataFrame([('[{"lemma":"go-v","senses":[{"definition":"d","examples":["e"]}]}]',), ('{"run":{"senses":[{"definition":"x"},{"definition":"y"}]}}',)], "value string")
    assert {(r.lemma, r.sense_id, r.definition) for r in readers.verb_senses(senses).collect()} == {("go", 0, "d"), ("run", 0, "x"), ("run", 1, "y")}
    for v in ('[{"url":"u"}]', '[[{"url":"u"}]]', '{"results":[{"url":"u"}]}', '{"search_results":[{"url":"u"}]}'):
        assert [r.url for r in readers.search_results(spark.createDataFrame([(v,)], "value string")).collect()] == ["u"]
    a = spark.createDataFrame([(0, "x"), (1, "y")], "sent_id int, sentence string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "sent_id int, sentence string")
    assert {tuple(r) for r in readers.parity(a, b).collect()} == {(1, "differs"), (2, "only in info")}


def test_services(spark):
    df = spark.createDataFrame([("a\nlast",), (None,), ("a\nlast",)], "p string")
    assert sorted(str(r.reply) for r in services.complete(df, "p").collect()) == ["None", "last", "last"]
    schema = "struct<a:int>"
    for v in ('{"a": 1}', 'so: ```json\n{"a": 1,}\n```', '"{\\"a\\": 1}"'):
        assert one(spark, services.json_object(F.col("v"), schema), v).a == 1
    assert one(spark, services.scores(F.col("v"), ["depth", "style"]), "Depth: 4.5, style = 5.1") == {"depth": 4.5, "style": None}
    assert services.visible_text("<p>A &amp; B</p><script>x</script><nav>n</nav>C") == "A & B\nC"
    assert abs(sum(x * x for x in services.hashed_vector("some words")) - 1) < 1e-9


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT canonical_topic('Ｖｅｌ 白皮书!') AS x").first().x == "vel白皮书"
    assert [r.sentence for r in spark.sql("SELECT * FROM sentence_rows('这是第一个很长的句子内容。短。')").collect()] == ["这是第一个很长的句子内容。"]


def test_token_stream():
    chunks = ["text [^", "3] more <ta", "ble>a", "b</table> end [", "x"]
    out = list(windows.held_blocks(chunks))
    assert "".join(out) == "".join(chunks) and "<table>ab</table>" in out
    assert not any(re.search(r"\[\^\d*$", o) for o in out[:-1])


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    data = [(dt.datetime(2024, 1, 1, h, m), "a" if m % 2 else "b") for h in range(3) for m in (1, 2, 3)] + [(dt.datetime(2024, 1, 9), "a")]
    df = spark.createDataFrame(data, "ts timestamp, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    q = windows.stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string", "1 hour", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in windows.tumbling(df, "1 hour").where("window_start < '2024-01-08'").collect()}


def test_unmatched_dimension_fails(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="no match for 2"):
        sequence.matched_or_fail(a, spark.createDataFrame([(1, "x")], "k int, n string"), "k").collect()
