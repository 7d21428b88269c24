"""Evidence and contents operators on small fixtures."""

from pyspark.sql import functions as F

from inkloom.operators import contents, evidence, sequence


def test_match_items(spark):
    corpus = spark.createDataFrame([(0, "青岭园区的试点"), (1, "长滩市与云服务商"), (2, None), (3, "长滩市")], "sent_id int, sentence string")
    items = spark.createDataFrame([("t", 1, 0, ["青岭园区"]), ("t", 2, 0, ["x"]), ("t", 3, 1, ["长滩市", "zz"]), ("t", 4, 3, ["云服务商", "长滩县"]), ("t", 5, 9, ["a"]), ("t", 6, 1, []), ("u", 7, 1, None), ("u", 8, 0, ["qq"])], "topic string, rank int, sent_id int, entities array<string>")
    got = {(r.topic, r.sent_id): (r.status, r.fallback_id, r.hits) for r in evidence.match_items(items, corpus).collect()}
    assert got == {("t", 0): ("FULL_MATCH", None, None), ("t", 1): ("PARTIAL_MATCH", None, None), ("t", 3): ("NO_MATCH_BY_INDEX", 1, 1), ("t", 9): ("INDEX_OUT_OF_RANGE", None, None), ("u", 1): ("NO_KEYWORDS", None, None), ("u", 0): ("NO_MATCH", None, None)}
    assert evidence.match_items(items.where("false"), corpus).count() == 0


def test_match_items_of_one_sign(spark):
    corpus = spark.createDataFrame([(0, "青岭园区的试点"), (1, "长滩市与云服务商"), (2, "云")], "sent_id int, sentence string")
    items = spark.createDataFrame([("t", 1, 0, ["云"]), ("t", 2, 2, ["长滩市", "市"])], "topic string, rank int, sent_id int, entities array<string>")
    got = {r.sent_id: (r.status, r.fallback_id, r.hits) for r in evidence.match_items(items, corpus).collect()}
    assert got == {0: ("NO_MATCH_BY_INDEX", 1, 1), 2: ("NO_MATCH_BY_INDEX", 1, 2)}


def test_excerpt_keeps_the_number(spark):
    passage = "This opening sentence says little. The latency fell to 42 ms in the second phase. Other sentences follow here without it. The final one is also long enough."
    far = "Latency and the second phase matter here. Nothing of note is said here. Again nothing is said here at all. Some more words without meaning. Only now it reads 42 ms at last."
    df = spark.createDataFrame([("Latency reached 42 ms", passage, ["42ms"]), ("nothing", "short", []), (None, None, None), ("latency second phase", far, ["42ms"]), ("latency", "", [])], "c string, p string, n array<string>")
    got = [r.excerpt for r in evidence.excerpts(df.coalesce(1), "c", "p", F.col("n"), most=90).collect()]
    assert "42 ms" in got[0] and len(got[0]) <= 90 and got[1] == "short" and got[2] is None and got[4] == ""
    assert "42 ms" in evidence.excerpts(df, "c", "p", F.col("n"), most=900).where("p like 'Latency and%'").first().excerpt


def test_snippets(spark):
    cited = spark.createDataFrame([(1, 0, "系统的平均时延下降明显。"), (2, 0, "别的句子在这里出现。"), (4, 0, None)], "ref int, pos int, sentence string")
    ev = spark.createDataFrame([(1, 0, "在第二阶段的测试之中，系统的平均时延下降到了四十毫秒。无关的一句话放在这里作为干扰内容而已。"), (1, 1, "系统的平均时延下降" * 100 + "。"), (3, 0, None)], "ref int, pos int, text string")
    got = {r.ref: r.snippet for r in evidence.snippets(cited, ev).collect()}
    assert got[1] == "在第二阶段的测试之中，系统的平均时延下降到了四十毫秒。" and got[2] == "" and 3 not in got and got[4] == ""
    long = {r.ref: r.snippet for r in evidence.snippets(cited, ev.where("pos = 1")).collect()}
    assert long[1].startswith("系统的平均时延下降系统") and len(long[1]) == 900
    assert evidence.snippets(cited.where("false"), ev.where("false")).count() == 0


def test_grounding_spreads_over_sources(spark):
    text = "平均时延在第二阶段明显下降到四十毫秒。\n# 平均时延在第二阶段明显下降标题\n平均时延在第二阶段明显下降到四十毫秒。已有引用的句子在这里出现，足够长[^2]。"
    articles = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "这里的句子没有任何相关的证据可以引用。")], "doc_id int, text string")
    chunks = spark.createDataFrame([(1, 0, 1, "平均时延在第二阶段明显下降"), (1, 1, 2, "平均时延在第二阶段明显下降"), (1, 2, 3, "平均时延在第二阶段明显下降"), (1, 3, 9, None)], "doc_id int, ord int, ref int, text string")
    out = {r.doc_id: r.text for r in evidence.with_citations(evidence.grounded(articles, chunks)).collect()}
    lines = out[1].split("\n")
    assert lines[0].endswith("[^1]。") and "[^3]。已有" in lines[2] and lines[2].endswith("[^2]。") and "[^" not in lines[1]
    assert out[4] == "这里的句子没有任何相关的证据可以引用。" and out[3] == "" and 2 not in out


def test_small_choices(spark):
    lists = spark.createDataFrame([("g", 0, 0, "aa"), ("g", 0, 1, "bb"), ("g", 1, 0, "cccc"), ("g", 1, 1, "d"), ("g", 2, 0, "e")], "g string, l int, i int, t string")
    assert evidence.interleaved(lists, "g", "l", "i", "t", 5).first()["items"] == ["aa", "bb", "d"]
    df = spark.createDataFrame([(i,) for i in range(7)], "i int")
    assert [r.grp for r in evidence.even_split(df, "i", 3).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2, 2]
    kind = "o array<array<struct<word: string, weight: double>>>"
    some = spark.createDataFrame([([[("a", 2.0), ("b", 1.0)], [("c", 0.5)]],), ([[(str(i), 1.0) for i in range(9)]] * 4,)], kind).coalesce(1).select(evidence.mixes(F.col("o")).alias("m")).collect()
    assert [(x.words, x.weight) for x in some[0].m] == [(["a", "c"], 2.5), (["b", "c"], 1.5)] and len(some[1].m) == 100
    texts = spark.createDataFrame([(["x" * 1000, "y" * 100],)], "t array<string>").select(evidence.compact(F.col("t"), 700).alias("c")).first().c
    assert texts == ["x" * 500, "y" * 100]
    chunks = spark.createDataFrame([("g", 2, 7, None, "u", "t2"), ("g", 1, 3, "T", None, "t1")], "g string, o int, ref_id int, title string, url string, text string")
    r = evidence.evidence_blocks(chunks, "g", "o").first()
    assert r.refs == [3, 7] and r.evidence.startswith("[证据 ^3]\n标题：T")
    doc = spark.createDataFrame([("d", i, f"h{i}", "x" * 200) for i in range(20)], "k string, i int, h string, t string")
    last = sequence.running_context(doc, "k", "i", "h", "t").where("i = 19").first()
    assert last.context_headings == [f"h{i}" for i in range(3, 19)] and len(last.context_tail) == 1800


def test_contents(spark):
    files = spark.createDataFrame([("f", i, t) for i, t in enumerate(["1 前页", "目录\n1 总则", "2 A\n2 A", "--\n3", "4 末", "5 外"])] + [("g", 0, "1 x\n\nabc")], "folder string, file_idx int, text string")
    got = sorted((r.folder, r.line) for r in contents.candidate_lines(files).collect())
    assert got == [("f", "1 总则"), ("f", "2 A"), ("f", "4 末"), ("g", "1 x")]
    toc = spark.createDataFrame([(1, "# h\n\n----\n1 总则\n  1.1 目的\n#\n二、范围\n\t(一) 对象")], "doc_id int, text string")
    assert [(r.level, r.title, r.parent_l1) for r in contents.rows(toc).orderBy("seq").collect()] == [(1, "总则", None), (2, "目的", "总则"), (1, "范围", None), (2, "对象", "范围")]
    assert contents.check("1 总则\n 1.1 目的") == (True, "") and contents.check("总则") == (False, "总则") and contents.check("") == (False, "empty")
    assert contents.verdict("why\n2\n") == 2 and contents.verdict("none") == 1
    x = spark.createDataFrame([("1.2.3 a\n 4.5.6.7 b",)], "t string").select(contents.two_levels("t").alias("t")).first().t
    assert x == "1.2 a\n 4.5 b"
