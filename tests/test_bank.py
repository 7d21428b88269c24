"""Feature bank, senses, anchors and result files on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from inkloom.operators import anchors, bank, senses
from inkloom.operators.text import numeric_values
from inkloom.sources import results


def test_joins_of_a_bank(spark):
    units = spark.createDataFrame([(1, "a b", [3, 3, -1]), (2, None, None), (3, "c", [])], "unit_id int, phrase string, sents array<int>")
    found = spark.createDataFrame([(1, "x.2"), (1, "x.1"), (2, None)], "unit_id int, sense string")
    assert [(r.unit_id, r.sense) for r in bank.with_senses(units, found).collect()] == [(1, "x.1")]
    heads = spark.createDataFrame([("c", "h"), ("c", "h"), (None, "n")], "phrase string, head string")
    assert sorted((r.unit_id, r["head"]) for r in bank.with_heads(units, heads).collect()) == [(1, None), (2, None), (3, "h")]
    assert [tuple(r) for r in bank.node_links(units, "unit_id", "sents").collect()] == [(3, 1)]
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "unit_id int, v array<float>")
    assert {r.unit_id: r.v for r in bank.zero_filled(units.select("unit_id"), vec, "unit_id", "v", 2).collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    labels = spark.createDataFrame([(1, "Unknown"), (2, "L")], "unit_id int, l string")
    assert [(r.unit_id, r.l) for r in bank.gold_items(units, labels, "unit_id", "l").collect()] == [(2, "L")]
    m = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"c": 4}), ({"a": 1}, None)], "x map<string,int>, y map<string,int>")
    assert [r.m for r in m.coalesce(1).select(bank.merged(F.col("x"), F.col("y")).alias("m")).collect()] == [{"a": 1, "b": 3}, {"c": 4}, {"a": 1}]
    rows = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "prefix string, i int")
    known = spark.createDataFrame([("p", 2, "full p"), ("q", 5, "other")], "prefix string, n long, label string")
    assert sorted((r.i, r.label) for r in bank.recovered_labels(rows, "prefix", known).collect()) == [(1, "full p"), (2, "full p"), (3, None)]
    ents = spark.createDataFrame([([("A", "ORG"), ("B", "DATE")],), (None,)], "e array<struct<text:string,label:string>>")
    assert [r.e and [x.text for x in r.e] for r in ents.coalesce(1).select(bank.allowed_entities(F.col("e"), ["ORG"]).alias("e")).collect()] == [["A"], None]


def test_texts_of_nodes(spark):
    nodes = spark.createDataFrame([(1, "pump", True), (2, "valve", False), (3, "fan", False), (4, "rod", False), (5, "nut", True)], "node int, word string, base boolean")
    told = spark.createDataFrame([(1, "the pump runs")], "node int, text string")
    near = spark.createDataFrame([(2, 1), (3, 5), (2, 5)], "node int, other int")
    assert {r.node: r.text for r in bank.node_texts(nodes, told, near).collect()} == {1: "the pump runs", 2: "the valve runs", 3: "fan", 4: "rod", 5: "nut"}


def test_outcomes(spark):
    df = spark.createDataFrame([(3,), (0,), (-2,), (None,)], "s int")
    assert {r.status: r.n for r in bank.outcome_counts(df, bank.sense_outcome(F.col("s"))).collect()} == {"success": 1, "error": 2, "skipped": 1}


def plain_overlap(a, b, p=0.9):
    depth = min(len(a), len(b))
    if not depth:
        return 0.0
    agree = [len(set(a[:d]) & set(b[:d])) for d in range(1, depth + 1)]
    return (1 - p) / p * sum(p**d * x / d for d, x in enumerate(agree, 1)) + agree[-1] / depth * p**depth


def test_senses(spark):
    mentions = spark.createDataFrame([(1, "run", [1.0, 0.0], ["go", "fast"]), (2, "run", [0.0, 1.0], ["drive"]), (3, "eat", None, None), (4, "", [1.0], None), (5, "zz", [1.0], None), (6, "run", None, ["go"])], "mention int, lemma string, vector array<double>, words array<string>")
    known = spark.createDataFrame([("run", 0, [1.0, 0.0], ["go", "move"]), ("run", 1, [0.0, 1.0], ["drive", "manage"]), ("eat", 7, [1.0], [])], "lemma string, sense_id int, vector array<double>, words array<string>")
    got = {r.mention: (r.sense_id, r.score) for r in senses.resolve(mentions, known).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 0, 2: 1, 3: 7, 4: senses.NO_LEMMA, 5: senses.NO_SENSE, 6: senses.NO_VECTOR}
    want = 0.6 + 0.3 * plain_overlap(["go", "fast"], ["go", "move"]) + 0.1
    assert got[1][1] == pytest.approx(want)
    ex = spark.createDataFrame([("s", 1, ["a", "b", "a"]), ("s", 2, ["b"])], "sense string, e int, w array<string>")
    feats = {r.lemma: r.score for r in senses.sense_features(ex, ["sense"], "e", "w").collect()}
    assert feats == pytest.approx({"a": 1 / math.log(2), "b": 1 / math.log(3) + 1 / math.log(2)})
    entries = spark.createDataFrame([("run-v", 0, ["x"]), ("run-v", 1, None), ("cat-n", 0, [])], "lemma string, sense_id int, examples array<string>")
    new = spark.createDataFrame([("run-v", 0, ["y"])], "lemma string, sense_id int, examples array<string>")
    assert sorted((r.lemma, r.sense_id, r.examples) for r in senses.rekeyed(entries, new).collect()) == [("cat", 0, []), ("run", 0, ["y", "x"]), ("run", 1, [])]
    w = spark.createDataFrame([("开展", None), ("实现化", None), ("重建", None), ("猫", "VERB"), ("狗", "NOUN"), ("重", None)], "w string, t string")
    is_verb = senses.is_verb(F.col("w"), ["开展"], ["化"], ["重"], F.col("t"))
    assert [r.v for r in w.coalesce(1).select(is_verb.alias("v")).collect()] == [True, True, True, True, False, False]
    one = spark.createDataFrame([("run-v", ["a"]), ("go-v", ["a", "b"]), ("cat-n", ["a"])], "lemma string, senses array<string>")
    assert sorted(r.lemma for r in senses.worth_resolving(one).collect()) == ["cat-n", "go-v"]
    assert spark.range(1).select(senses.normalized_token(F.lit(" “Ab-C!” ")).alias("t")).first().t == "abc"


PASSAGES = [(1, 10, "t", "系统的平均时延在第二阶段下降到42ms，效果明显。"), (2, 10, "t", "关于别的主题的一段很长很长很长很长很长很长很长的文字。"), (3, 11, "t", "系统的平均时延在第二阶段下降到了77ms，系统平均时延下降明显，第二阶段效果很好。"), (4, 12, "u", "无关")]


def test_rebinding(spark):
    passages = spark.createDataFrame(PASSAGES, "pid int, ref int, topic string, text string")
    seg = spark.createDataFrame([(1, 10, "t", "平均时延下降到42ms"), (2, 10, "t", "第二阶段系统平均时延下降到77ms"), (3, 10, "t", "时延为99ms"), (4, 10, "t", "完全没有共同词"), (5, 12, "t", "第二阶段下降")], "seg int, ref int, topic string, text string")
    got = {r.seg: r for r in anchors.rebound(seg, passages, "topic").collect()}
    assert (got[1].pid, got[1].bound_ref, got[1].dropped) == (1, 10, False)
    assert (got[2].pid, got[2].bound_ref) == (3, 11)  # only the other source has the number
    assert got[3].dropped and got[3].pid is None and got[3].anchor is None
    assert (got[4].pid, got[4].dropped) == (2, False)  # the longest passage of its source
    assert got[5].bound_ref in (10, 11)
    kept = {r.seg: r for r in anchors.rebound(seg, passages, "topic", edit=False).collect()}
    assert kept[3].pid == 2 and not kept[3].dropped
    assert len(got[1].anchor.split(":")) == 3
    bound = anchors.rebound(seg, passages, "topic")
    per = {r.ref: r for r in anchors.by_source(bound, passages.select("pid", "text"), 40).collect()}
    assert per[10].claims == 3 and per[10].pid == 1 and len(per[10].text) <= 40
    ids = anchors.first_use_ids(bound.withColumn("doc", F.lit(1)), "doc", "seg").collect()
    assert sorted(r.new_id for r in ids) == list(range(1, len(ids) + 1))


def _moved(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rebinding_shuffles_no_pairs(spark):
    """A scope's segments and passages that all share words: their pairs stay in the tasks."""
    n = 300
    passages = spark.createDataFrame([(i, i, "t", f"alpha beta gamma delta word{i % 50} " + "more " * (i % 3)) for i in range(n)], "pid int, ref int, topic string, text string")
    seg = spark.createDataFrame([(i, i, "t", f"alpha beta gamma delta word{i * 7 % 50} own{i}") for i in range(n)], "seg int, ref int, topic string, text string")
    before = _moved(spark)
    got = anchors.rebound(seg, passages, "topic").collect()
    assert len(got) == n and _moved(spark) - before < n * n / 10


def test_collapsed_sources_shuffle_no_pairs(spark, tmp_path):
    """The whole query, with repeated rows, over a topic whose titles and chunks all share words."""
    from inkloom.plans import catalog

    n = 300
    sources = [(i, "t", f"alpha beta gamma delta word{i}") for i in range(n)]
    chunks = [(i, k, f"alpha beta gamma delta word{i} part{k}") for i in range(n) for k in (0, 1)]
    spark.createDataFrame(sources + sources[:9], "ref_id int, topic_id string, title string").write.parquet(f"{tmp_path}/source_documents.parquet")
    spark.createDataFrame(chunks + chunks[:9], "ref_id int, chunk_id int, text string").write.parquet(f"{tmp_path}/evidence_chunks.parquet")
    before = _moved(spark)
    got = catalog.queries()["collapsed_sources"](spark, str(tmp_path)).collect()
    assert _moved(spark) - before < n * n / 10
    assert sorted((r.ref, r.pid, r.claims, r.text) for r in got) == [(i, i << 20, 1, chunks[2 * i][2]) for i in range(n)]


def test_rebinding_by_blocks(spark, monkeypatch):
    """Blocks, equal texts, null scopes and more words than are cut against every pair."""
    import random

    draw = random.Random(5)
    words = [f"w{i}" if i % 3 else f"词{chr(0x4E00 + i)}" for i in range(30)] + ["42ms", "15%", "99kg"]
    text = lambda k: " ".join(draw.choices(words, k=k))
    held = [(i, i // 3, draw.choice("ttttu"), text(12)) for i in range(150)] + [(150, 50, None, text(12)), (151, 50, "t", None), (152, 51, "t", "")]
    asked = [(i, i % 53, draw.choice(["t", "t", "u", None]), text(draw.randint(2, 6)) if i % 9 else "w1 w2 w4") for i in range(120)] + [(120, 3, "t", None), (121, 3, "t", "")]
    passages, seg = spark.createDataFrame(held, "pid int, ref int, topic string, text string"), spark.createDataFrame(asked, "seg int, ref int, topic string, text string")
    cite = seg.where("text is not null")
    best = lambda within: {r.seg: r.b for r in anchors._best(anchors.passage_scores(cite, passages, within), cite, passages).collect()}
    mine, anywhere = best(["ref"]), best(["topic"])
    numeric = {r.seg for r in cite.where(F.size(numeric_values(F.col("text"))) > 0).collect()}

    def want(seg: int, ref: int) -> tuple:
        own, other = mine.get(seg), anywhere.get(seg)
        if other and other.ref != ref and other.score >= max(4, (own.score if own else 0) + 1):
            return other.pid, other.ref, False
        if own or seg in numeric:
            return (own.pid, ref, False) if own else (None, None, True)
        of = [(len(t or ""), -p) for p, r, _, t in held if r == ref and t is not None] or [(0, -p) for p, r, _, _ in held if r == ref]
        return (-max(of)[1], ref, False) if of else (None, None, False)

    expected = {s: want(s, r) for s, r, _, t in asked if t is not None}
    for block, vocabulary in ((1 << 14, 20000), (16, 20000), (16, 3)):
        monkeypatch.setattr(anchors, "BLOCK", block)
        monkeypatch.setattr(anchors, "VOCABULARY", vocabulary)
        got = {r.seg: (r.pid, r.bound_ref, r.dropped) for r in anchors.rebound(seg, passages, "topic").collect()}
        assert {s: got[s] for s in expected} == expected and len(got) == len(asked)
    assert sum(v[2] for v in expected.values()) and sum(v[1] not in (None, asked[s][1]) for s, v in expected.items())


def test_grounding_of_segments(spark):
    passages = spark.createDataFrame(PASSAGES, "pid int, ref int, topic string, text string")
    seg = spark.createDataFrame([(1, "t", "根据测试，系统的平均时延在第二阶段下降到了42ms，效果比较明显。"), (2, "t", "短句42ms"), (3, "t", "根据测试，系统的某项指标在最后一个阶段达到了99ms的水平，令人满意。"), (4, "t", "这是一句没有事实词的普通长句子，只是为了测试而写得很长很长。"), (5, "t", None)], "seg int, topic string, text string")
    got = {r.seg: (r.pid, r.dropped) for r in anchors.grounded_segments(seg, passages, "topic").collect()}
    assert got[1] == (1, False) and got[2] == (None, False) and got[3] == (None, True) and got[4] == (None, False)
    cautious = {r.seg: (r.pid, r.dropped) for r in anchors.grounded_segments(seg, passages, "topic", edit=False).collect()}
    assert cautious[1] == (None, False) and cautious[3] == (None, True)


def test_outlines(spark):
    df = spark.createDataFrame([("1 总则\n1.1 目的\n1.1.1 细节\n正文",), ("# a\n## b",), ("text",)], "o string").coalesce(1)
    got = df.select(anchors.headings(F.col("o")).alias("h"), anchors.outline_form(F.col("o")).alias("f")).collect()
    assert got[0].h == "# 总则\n## 目的\n### 细节\n正文" and [r.f for r in got] == ["numbered", "headings", "plain"]
    ids = spark.createDataFrame([([2, 1, 9],)], "p array<int>").select(anchors.real_ids(F.col("p"), F.create_map(F.lit(1), F.array(F.lit(5), F.lit(3)), F.lit(2), F.array(F.lit(3)))).alias("r")).first().r
    assert ids == [3, 5]
    x = spark.createDataFrame([("abcdefghij",), ("abc",), (None,)], "t string").coalesce(1).select(anchors.bounded(F.col("t"), 3, 2).alias("b")).collect()
    assert [r.b for r in x] == ["abc…ij", "abc", None]


def test_score_files(spark, tmp_path):
    def put(name, docs):
        (tmp_path / name).write_text(json.dumps({"documents": docs}), encoding="utf-8")
        return str(tmp_path / name)

    a = put("a.json", [{"topic": "x", "scores": {"m1": 3.0}}, {"topic": "y", "scores": {"m1": 4.0}}])
    b = put("b.json", [{"topic": "x", "scores": {"m2": 2.0}}, {"topic": "y", "scores": {}}])
    c = put("c.json", [{"topic": "x", "scores": {"m3": 1.0}}])
    one = results.unified_scores(spark, [str(tmp_path / "none.json"), a], "M")
    assert sorted(map(tuple, one.collect())) == [("M", "x", "m1", 3.0), ("M", "y", "m1", 4.0)]
    assert results.legacy_scores(spark, {"p": a, "q": b}, "M").count() == 3
    with pytest.raises(Exception, match="not in every group"):
        results.legacy_scores(spark, {"p": a, "q": c}, "M").collect()
    with pytest.raises(FileNotFoundError):
        results.first_of(spark, [str(tmp_path / "none.json")])
    assert results.all_methods(spark, [f"A={a}", f"B={b}"]).select("method").distinct().count() == 2
    assert results.variant("x=a=b") == ("x", "a=b")
    with pytest.raises(ValueError):
        results.variant("nothing")
    df = one.select("topic", "metric")
    assert results.selected(df, "topic", most=1).count() == 1 and results.selected(df, "topic").count() == 2
    with pytest.raises(LookupError):
        results.selected(df, "topic", spark.createDataFrame([("z",)], "t string"))
    lines = spark.createDataFrame([(1, '{"topic": "x", "s": 1}'), (2, "no json"), (3, '{"topic": "x", "s": 2}')], "n int, value string")
    assert [tuple(r) for r in results.prior_results(lines, "value", "topic string, s int", "topic", "n").collect()] == [("x", 2)]


def test_reports_and_places(spark, tmp_path):
    pages = spark.createDataFrame([("t", 1, "A", "src", "u", "x\n\ny"), ("t", 2, None, None, None, "z"), ("t", 3, "C", "s", "u", "")], "k string, i int, title string, source string, url string, body string")
    r = results.collection_report(pages, "k", "i").first()
    assert r.corpus == "x y\nz" and r.report.startswith("[文章 1] A [src]\nURL: u\n正文：\nx") and "[文章 2]  []" in r.report
    items = spark.createDataFrame([("t", 0, "FULL_MATCH", None), ("t", 1, "NO_MATCH_BY_INDEX", 0)], "topic string, sent_id int, status string, fallback_id int")
    corpus = spark.createDataFrame([(0, "null"), (1, "eins")], "sent_id int, sentence string")
    assert sorted(x.line for x in results.match_lines(items, corpus).collect()) == ["[sent_id=0] [FULL_MATCH] null", "[sent_id=1] [NO_MATCH_BY_INDEX] eins\n  -> [sent_id=0] null"]
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "p1.md").write_text("page")
    (tmp_path / "book" / "toc.md").write_text("made later")
    assert [(x.folder, x.file, x.text) for x in results.page_files(spark, str(tmp_path)).collect()] == [("book", "p1.md", "page")]
    (tmp_path / "a.txt").write_text("x")
    assert results.source_folder(spark, str(tmp_path), "topic", "a").endswith("a.txt")
    (tmp_path / "t_outline.md").write_text("x")
    assert results.outline_file(spark, str(tmp_path), "t").endswith("t_outline.md")
    topics = spark.createDataFrame([("a", "energy"), ("b", "x"), ("c", None)], "id string, domain string")
    known = spark.createDataFrame([("energy", 3)], "domain string, n int")
    assert {x.id: x.route for x in results.report_domain(topics, known).collect()} == {"a": "energy", "b": "generic", "c": "generic"}


def test_edges_of_a_graph(spark):
    from inkloom.operators import graph

    u = spark.createDataFrame([(1, "run", "pump", ["Ada"]), (1, "stop", None, ["Ada", None]), (2, None, "x", ["y"]), (3, "a", "a", None)], "sent_id int, verb string, object string, entities array<string>")
    near = spark.createDataFrame([("pump", "water", 2.0, "zh"), ("pump", "eau", 5.0, "fr"), ("pump", "w", 0.5, "zh"), ("other", "z", 3.0, "zh"), ("run", "pump", 1.0, "zh")], "src string, dst string, weight double, lang string")
    got = {(r.src, r.dst): r.weight for r in graph.evidence_edges(u, near).collect()}
    assert got == {("run", "pump"): 9.0, ("run", "Ada"): 9.0, ("pump", "water"): 2.0}
    assert graph.evidence_edges(u.where("false")).count() == 0


def test_services(spark, tmp_path):
    from inkloom.functions import services

    pool = services.KeyPool(["bad", "good"])

    def ask(key):
        if key == "bad":
            raise RuntimeError("quota")
        return key

    assert [pool.call(ask) for _ in range(3)] == ["good"] * 3
    with pytest.raises(RuntimeError):
        services.KeyPool(["bad"]).call(ask)
    q = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "q string")

    def engine(key, text):
        if key == "k1" or text == "b":
            raise RuntimeError("no")
        return [{"url": f"u/{text}", "title": "t"}, {"url": "seen"}]

    seen = spark.createDataFrame([("seen",)], "url string")
    got = sorted((r.q, r.url, r.error) for r in services.searched(q.coalesce(1), "q", engine, ["k1", "k2"], seen).collect())
    assert got == [("a", "u/a", None), ("b", None, "no")]
    path = str(tmp_path / "memo")

    def fetch(k):
        if k == "b":
            raise RuntimeError("down")
        return k.upper()

    assert [tuple(r) for r in services.fetched(q, "q", fetch, path, tries=1).collect()] == [("a", "A")]
    assert sorted(tuple(r) for r in services.fetched(q, "q", str.title, path, tries=1).collect()) == [("a", "A"), ("b", "B")]
    bad = spark.createDataFrame([(1, None), (2, "x" * 500)], "k int, e string")
    r = services.failures(bad, "k", F.when(F.col("e").isNotNull(), "error"), F.col("e")).collect()
    assert len(r) == 1 and len(r[0].detail) == 300
    plan = spark.createDataFrame([("s", "c1", "平均时延在第二阶段 下降到"), ("s", "c2", "短"), ("s", "c3", "这句话并不在任何一段证据里面")], "section string, child string, quote string")
    held = spark.createDataFrame([("s", "其中平均时延在第二阶段下降到四十毫秒")], "section string, text string")
    assert [x.child for x in services.quoted_children(plan, held).collect()] == ["c1"]
    d = spark.createDataFrame([("p",), ("p",), (None,)], "prompt string")
    assert sorted((x.prompt or "", x.reply) for x in services.complete(d, "prompt").collect()) == [("", None), ("p", "p"), ("p", "p")]


def test_small_columns(spark):
    from inkloom.operators import contents, sequence, text, units, vectors
    from inkloom.sources import readers

    r = spark.range(1).select(text.token_windows(F.lit(1000)).alias("w"), text.window_of(F.lit(1000), F.lit(600)).alias("o"), text.ordered_union(F.array(F.lit(2), F.lit(1)), F.lit(None).cast("array<int>"), F.array(F.lit(1), F.lit(3))).alias("u"), text.long_enough(F.lit(None).cast("string")).alias("n")).first()
    assert [(x.start, x.end) for x in r.w] == [(0, 510), (255, 765), (510, 1000)] and (r.o.window, r.o.offset) == (2, 90) and r.u == [2, 1, 3] and r.n is False
    parts = spark.createDataFrame([("g", 1, 1, "A"), ("g", 2, 2, "x"), ("g", 3, 1, "B"), ("g", 4, 2, "y"), ("g", 5, 2, "z"), ("g", 6, 3, "q")], "g string, i int, level int, title string")
    assert [x.number for x in contents.renumbered(parts, "g", ["i"]).orderBy("i").collect()] == ["1", "1.1", "2", "2.1", "2.2", None]
    refs = spark.createDataFrame([("https://A.example/x/", 7), ("b.example", 3), (None, 9)], "url string, id int")
    asked = spark.createDataFrame([("k", ["http://a.example/x", "b.example/", None]), ("m", ["zz"]), ("n", None)], "k string, urls array<string>")
    assert [tuple(x) for x in sequence.ids_of_urls(asked, "k", "urls", refs).collect()] == [("k", [3, 7])]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float(i) for i in range(9)]), (3, None)], "i int, v array<double>").coalesce(1)
    got = [x.v for x in vectors.projected(v, "v", 4).collect()]
    assert got[0] == [1.0, 2.0, 0.0, 0.0] and len(got[1]) == 4 and got[2] is None
    assert got[1] == vectors.projected(v.where("i = 2"), "v", 4).first().v
    t = spark.createDataFrame([('[{"domain": "d", "topics": ["a", " ", "b"]}]',), ("no json",)], "value string")
    assert sorted(tuple(x) for x in readers.tasks(t).collect()) == [("a", "d"), ("b", "d")]
    tokens = units.parsed(spark.createDataFrame([(1, "a b"), (2, None)], "sent_id int, sentence string"), lambda s: [units.Token(i, w, w, "NOUN", "ROOT", i) for i, w in enumerate(s.split())])
    assert tokens.count() == 2


def test_blocks_over_micro_batches(spark, tmp_path):
    from inkloom.streaming import windows

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    rows = [[("a", 0, "x <tab", False), ("b", 0, "see [^", False)], [("a", 1, "le>1</table> y", False), ("b", 1, "3] end", True)], [("a", 2, " z", True)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "reply string, seq int, chunk string, last boolean").coalesce(1).write.mode("overwrite").json(str(tmp_path / f"t{i}"))
        (part,) = (tmp_path / f"t{i}").glob("part-*.json")
        part.rename(folder / f"{i}.json")
    chunks = spark.readStream.schema("reply string, seq int, chunk string, last boolean").option("maxFilesPerTrigger", 1).json(str(folder))
    q = windows.whole_blocks(chunks).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.reply, r.text) for r in spark.read.parquet(str(out)).orderBy("seq").collect()]
    assert "".join(t for r, t in got if r == "a") == "x <table>1</table> y z" and "".join(t for r, t in got if r == "b") == "see [^3] end"
    assert not any("<tab" in t and "</table>" not in t for _, t in got) and not any(t.endswith("[^") for _, t in got)


def test_masks_prompts_and_extra_vectors(spark, tmp_path):
    from inkloom.functions import render
    from inkloom.sources import readers

    kind = "m array<array<struct<word: string, weight: double>>>"
    df = spark.createDataFrame([([[("ab", 0.4), ("c", 0.1)], [("##d", 0.9)]],), ([],)], kind).coalesce(1).select(senses.mask_candidates(F.col("m")).alias("c")).collect()
    assert [(x.word, round(x.weight, 6)) for x in df[0].c] == [("abd", 0.6)] and not df[1].c
    p = spark.range(1).select(render.judged_prompt("Judge.", {"clear": "is it"}, text=F.lit("T"), more=F.lit(None).cast("string")).alias("p")).first().p
    assert p.startswith("Judge.\n\nScore each metric from 0 to 5.\n1. clear: is it") and p.endswith("[text]\nT\n\n[more]\n")
    assert readers.auxiliary_vectors(spark, str(tmp_path / "none"), "k", "v").count() == 0
    spark.createDataFrame([(1, [1.0]), (1, [1.0])], "k int, v array<double>").write.parquet(str(tmp_path / "some"))
    assert readers.auxiliary_vectors(spark, str(tmp_path / "some"), "k", "v").count() == 1
