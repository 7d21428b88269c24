"""Small cases of every training-data operator: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names; each against brute
force, an exact round trip or known truth."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("inkloom.llm")
from inkloom.llm import boilerplate, clusters, lookalike, mojibake, packing, pages, sentences, site_lines, splitting, templates, tokenizing  # noqa: E402

TEXTS = [None, "", "   ", "Ein Satz.", "系统会在切换" * 4000, "word " * 6000, "a" * 20000, "<|endoftext|> plain", "Ein Satz."]


def rows(df):
    return sorted(map(tuple, df.collect()))


# ---------------------------------------------------------------- tokenizer


def test_ids_equal_the_library(spark):
    import os

    if not os.path.exists(tokenizing.FOLDER):
        pytest.skip("no vocabulary")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizing.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.createDataFrame([(i, x, "ids", 0) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string, k int")
    got = {r.doc_id: r.ids for r in tokenizing.encode_documents(docs, leaf=512, block=2).collect()}
    for i, x in enumerate(TEXTS):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), i
    assert tokenizing.encode_documents(docs.where("false")).count() == 0


def test_tree_joins_are_exact():
    e = tokenizing.encoder()
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh 系统测试。's\n") for _ in range(6000)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(5000)), " " * 3000 + "x", "'s" * 2000, "naïve" * 900]
    texts += ["0123456789" * 700, "дом" * 2000, "".join(rng.choice("कखगघचछजझ") for _ in range(6000)), "\n" * 4000 + " " * 3000 + "\tx", "-=" * 3000, "?!" * 2500 + "ab" * 2500, "\u3000 " * 2500, " \u00a0\n" * 1500 + "'s", "e\u0301" * 2500]
    for t in texts:
        for leaf in (50, 400):
            cut = tokenizing.halves(t, leaf)
            assert "".join(p for p, _ in cut) == t
            assert len(cut) > 1 and max(len(p) for p, _ in cut) <= 2 * leaf, t[:20]
            assert tokenizing.tree_concat([(tokenizing.encode(p), s) for p, s in cut], e).tolist() == e.encode_ordinary(t)


# ------------------------------------------------------------------ packing


def test_packing_splits_only_the_oversized():
    rng = random.Random(1)
    sizes = [rng.randint(1, 900) for _ in range(4000)] + [5000, 512, 0]
    bins = packing.pack_sizes(sizes, 512)
    assert all(sum(n for _, _, n in b) <= 512 for b in bins)
    back = {}
    for b in bins:
        for item, start, n in b:
            back.setdefault(item, []).append((start, n))
    for i, n in enumerate(sizes):
        parts = sorted(back.get(i, []))
        assert sum(p for _, p in parts) == n and (len(parts) <= 1 or n > 512)
    assert len(bins) <= 1.03 * sum(sizes) / 512 + 1


@pytest.mark.parametrize("n", [500, 10000])
def test_packing_of_small_and_large_tasks(n):
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(6.3, 1.0, n).astype(int), 1, None).tolist()
    bins = packing.pack_sizes(sizes, 2048)
    assert sum(sizes) / 2048 / len(bins) > (0.98 if n < 1000 else 0.995)


def test_packing_documents(spark):
    docs = spark.createDataFrame([(i, x, 7) for i, x in enumerate(TEXTS)], "doc_id long, text string, capacity int")
    got = packing.pack_documents(docs, [512, 2048, None, 512], group=3)
    ids = [(r.capacity, r.doc_id, r.piece, r.start_token) for r in got.collect()]
    assert len(ids) == len(set(ids))
    for c in (512, 2048):
        whole = {i: len(tokenizing.encode(x)) for i, x in enumerate(TEXTS)}
        back = {}
        for r in got.where(f"capacity = {c}").collect():
            back[r.doc_id] = back.get(r.doc_id, 0) + r.n_tokens
        assert back == whole
    per = got.where("container_id is not null").groupBy("capacity", "container_id").sum("n_tokens").collect()
    assert all(r[2] <= r.capacity for r in per)
    assert {r.doc_id for r in got.where("container_id is null").collect()} == {0, 1}
    assert packing.pack_documents(docs.where("false"), [512]).count() == 0


# ---------------------------------------------------------------- look-alike


def test_lookalikes(spark):
    pairs = [("Ｖｅｌｍｏｎｔ ｶﾞ", "Velmont ガ"), ("Café ﬁn", "Café fin"), ("оpen​", "open"), ("a　b c", "a b c"), ("⼀更", "一更"), ("ρaper օn Ꮯat ѵiew", "paper on Cat view")]
    data = [(2 * i, a) for i, (a, b) in enumerate(pairs)] + [(2 * i + 1, b) for i, (a, b) in enumerate(pairs)]
    data += [(100, "x²"), (101, "x2"), (102, "Cafe"), (103, "Café"), (104, "ABC"), (105, "abc"), (106, None), (107, ""), (108, " "), (109, "​"), (110, "same"), (111, "same"), (112, "👩‍🔧"), (113, "👩🔧"), (0, pairs[0][0])]
    docs = spark.createDataFrame([(*r, "x", "y") for r in data], "doc_id long, text string, look string, canonical string")
    # 103 and the second pair are different texts
    assert rows(lookalike.lookalike_pairs(docs)) == [(2 * i, 2 * i + 1) for i in range(len(pairs))]
    forms = {r.doc_id: r.canonical for r in lookalike.canonical_texts(docs).collect()}
    assert forms[106] is None and forms[107] == "" and forms[0] == forms[1] == "Velmont ガ"
    assert lookalike.lookalike_pairs(docs.where("false")).count() == 0
    classes = lookalike.lookalike_classes(docs).collect()
    assert {r.doc_id for r in classes} == set(range(2 * len(pairs))) and len({r.look for r in classes}) == len(pairs)


def test_forms_against_plain_python(spark):
    """The form of whole documents, worked out again from the Unicode data."""
    import os
    import unicodedata

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    one, to, longer = lookalike.tables()
    table = {ord(a): b for a, b in zip(one, to)} | {ord(a): b for a, b in longer.items()}
    keep = lambda c: unicodedata.category(c) not in ("Cf", "Cc") and not 0xFE00 <= ord(c) <= 0xFE0F or c in "\n\t\x0b\x0c\r\x85"
    for r in lookalike.canonical_texts(spark.read.parquet(path)).collect():
        if r.text is not None and "\u200d" not in r.text:
            plain = unicodedata.normalize("NFC", r.text.replace("\r\n", "\n"))
            want = unicodedata.normalize("NFC", "".join(table.get(ord(c), c) for c in plain if keep(c)))
            assert r.canonical == want


# ------------------------------------------------------------------ encoding

GOOD = ["“Café” – naïve façade 3 × 4 ½ Größe «été»\xa0 Ω≈3 √2", "联通公司的路由，每个么", "В\xa0площадке «СССР» Сёрфинг", "हिन्दी पाठ", "検証と観測のデータ ｱｲｳ", "Kube路由 RoCE每", "groß“ und À’", "區塊鏈節點", "", "plain"]


def test_correct_text_is_left_alone():
    for t in GOOD:
        assert not mojibake.is_garbled(t), t
        assert mojibake.restore(t) == t


@pytest.mark.parametrize("text,written,read_as", [("Téléchargements : l'énergie", "utf-8", "cp1252"), ("Carrières", "utf-8", "mac_roman"), ("Главная страница", "utf-8", "cp1251"), ("长滩市能耗管理现状与需求", "gbk", "latin-1"), ("电力会社のプライバシー", "utf-8", "cp932"), ("质量追溯系统的灰度发布", "utf-8", "latin-1"), ("die Prüfdauer bleibt", "utf-8", "gbk"), ("质量追溯系统的灰度发布", "gbk", "big5")])
def test_garbled_text_is_restored(text, written, read_as):
    try:
        bad = text.encode(written).decode(read_as)
    except UnicodeDecodeError:
        bad = text.encode(written).decode(read_as, "replace")
        assert mojibake.is_garbled(f"ok {bad}")
        return
    assert mojibake.is_garbled(bad)
    assert mojibake.restore(bad) == text


ROUND = ["Die Prüfung der Größen läuft über drei Tage – „ohne Störung“.", "La qualité des données dépend d'un décodage précis, à vérifier.", "Проверка данных идёт в три этапа, а затем снова с начала.", "系统会在三毫秒内切换到备用路径，并核对数据。", "データの検証は三つの段階で行われ、記録される。", "데이터 품질은 올바른 인코딩에 달려 있다."]


@pytest.mark.parametrize("read_as,times", [*((c, 1) for c in ("latin-1", "mac_roman", "cp1251", "koi8_r", "cp437", "cp850", "cp866", "cp1253", "mac_cyrillic")), ("latin-1", 5)])
def test_utf8_comes_back_whole(read_as, times):
    for text in ROUND:
        bad = text
        try:
            for _ in range(times):
                bad = bad.encode().decode(read_as)
        except UnicodeDecodeError:
            continue
        if len(bad) < 20000:
            assert mojibake.is_garbled(bad), text
            assert mojibake.restore(bad) == text


def test_garbled_ids(spark):
    twice = "会员服务".encode().decode("latin-1").encode().decode("latin-1")
    data = [(1, None), (2, ""), (3, "fine"), (4, "Ors�ne"), (4, "fine"), (5, twice), (5, twice)]
    df = spark.createDataFrame([(*r, "k") for r in data], "id int, content string, t string")
    assert rows(mojibake.garbled_ids(df)) == [(4,), (5,)]
    back = {(r.id, r.content) for r in mojibake.restored(df).collect()}
    assert (5, "会员服务") in back and (1, None) in back and (2, "") in back
    assert mojibake.garbled_ids(df.where("false")).count() == 0


# ----------------------------------------------------------------- sentences

CASES = {
    "In the hub, Dr. Orla Venk saw 3.5 km. See Fig. 3, e.g. at docs.velmont.example. “Stop!” was heard. Ms. A. B. Ardane added: “cost is high.” Next.": ["In the hub, Dr. Orla Venk saw 3.5 km.", "See Fig. 3, e.g. at docs.velmont.example.", "“Stop!” was heard.", "Ms. A. B. Ardane added: “cost is high.”", "Next."],
    "“上线！上线！”值班日志只写了这几个字。港航单位问：“怎么接入？”与上一阶段相比……建议优先！ 好": ["“上线！上线！”值班日志只写了这几个字。", "港航单位问：“怎么接入？”", "与上一阶段相比……", "建议优先！", "好"],
    "「誰が負担するのか。」と質問した。次の文。": ["「誰が負担するのか。」と質問した。", "次の文。"],
    "Am 731. Prüftag, z. B. heute. „Wer zahlt?“ fragten sie. Ende?! Ja": ["Am 731. Prüftag, z. B. heute.", "„Wer zahlt?“ fragten sie.", "Ende?!", "Ja"],
    "« Qui paiera ? » demandaient-ils. Env. 3 km ! Dès lors.": ["« Qui paiera ? » demandaient-ils.", "Env. 3 km !", "Dès lors."],
    "См. рис. 6. «Кто?» — спросили. Да.": ["См. рис. 6.", "«Кто?» — спросили.", "Да."],
    "یہ پہلا جملہ ہے۔ یہ دوسرا ہے؟ تیسرا": ["یہ پہلا جملہ ہے۔", "یہ دوسرا ہے؟", "تیسرا"],
    "Սա է։ Երկրորդ։": ["Սա է։", "Երկրորդ։"],
    "ይህ ነው። ሁለተኛ።": ["ይህ ነው።", "ሁለተኛ።"],
    "ဒါပါ။ဒုတိယ။": ["ဒါပါ။", "ဒုတိယ။"],
    "Wow‼ Next⁇ End": ["Wow‼", "Next⁇", "End"],
    "यह वाक्य है। दूसरा वाक्य?": ["यह वाक्य है।", "दूसरा वाक्य?"],
    "1. Punkt eins\n\n  * Kopf \r\nEnd.As we go": ["1. Punkt eins", "* Kopf", "End.", "As we go"],
    "etc. See more. Tests ran 9 a.m. to 5 p.m. local time.": ["etc.", "See more.", "Tests ran 9 a.m. to 5 p.m. local time."],
}


def test_sentences(spark):
    data = list(enumerate(CASES)) + [(90, None), (91, ""), (92, " \n　"), (0, next(iter(CASES)))]
    df = spark.createDataFrame([(*r, "x") for r in data], "ref_id int, body string, parts string")
    got = {}
    for r in sentences.sentences(df.distinct(), text=True).collect():
        body = data[r.ref_id][1]
        assert body[r.start_pos - 1 : r.end_pos] == r.sentence == r.sentence.strip()
        got.setdefault(r.ref_id, []).append((r.start_pos, r.sentence))
    for i, (_, want) in enumerate(CASES.items()):
        assert [s for _, s in sorted(got[i])] == want
    assert set(got) == set(range(len(CASES)))
    assert sentences.sentences(df.where("false")).count() == 0


def test_sentence_places_in_a_long_body(spark):
    body = "Satz eins. Zwei!\n" * 3000
    df = spark.createDataFrame([(1, body)], "ref_id int, body string")
    got = sorted((r.start_pos, r.end_pos) for r in sentences.sentences(df).collect())
    assert len(got) == 6000 and all(body[a - 1 : b] in ("Satz eins.", "Zwei!") for a, b in got)


# ----------------------------------------------------------------- splitting


def brute_pieces(text, limit, overlap, size):
    """The pieces, worked out over the whole text at once."""
    at, rank = (np.array(x, int) for x in splitting.ends(text, 0, 0, len(text)))
    span = splitting.span_of(len(text), limit, size)
    firsts = [splitting.plain_from(text, p) for p in range(0, len(text), span)] + [len(text)]
    overs = [splitting.handover(at[(at > a) & (at <= b)], rank[(at > a) & (at <= b)], a, b, limit) for a, b in zip(firsts, firsts[1:]) if a < b]
    begins = [0, *overs[:-1]]
    out = []
    for a, b in zip(begins, [*overs[:-1], len(text)]):
        out += splitting.choose(at[at <= b], rank[at <= b], a, b, limit, overlap) if b > a else []
    return out


@pytest.mark.parametrize("size", [64, 1000, 100000])
def test_ranges_equal_the_whole(spark, size):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["Wort ", "Satz. ", "行。", "\n", "\n\n", "x" * 9, " " * 40, ".”" * 30]) for _ in range(3000)), "y" * 9000, "a b\n\nc", None, ""]
    for at in (990, 4750, 4790, 4795, 4801):  # runs of blanks over the edge of a range
        texts.append("w " * (at // 2) + "." + "\n \n" * 350 + "v " * 4000)
    df = spark.createDataFrame([("F", i, -1, t, 300, 40, "z") for i, t in enumerate(texts)] + [("F", 0, -1, texts[0], 300, 40, "z")], "field string, rec_id long, chunk_id int, text string, max_size int, overlap int, item string")
    cut = splitting.ranges(splitting.oversized(df), size)
    got = {}
    for r in splitting.piece_texts(cut, splitting.pieces(cut)).collect():
        assert r.text == texts[r.rec_id][r.start : r.end] and len(r.text) <= 300
        got.setdefault(r.rec_id, []).append((r.piece, r.start, r.end))
    assert set(got) == {0, 1, *range(5, len(texts))}
    for i, rows_ in got.items():
        rows_.sort()
        assert [n for n, _, _ in rows_] == list(range(len(rows_)))
        assert [(a, b) for _, a, b in rows_] == brute_pieces(texts[i], 300, 40, size)
        ends = [b for _, _, b in rows_]
        assert rows_[0][1] == 0 and ends[-1] == len(texts[i]) and all(0 < e - a[1] <= 40 for e, a in zip(ends, rows_[1:]))
    assert splitting.pieces(splitting.ranges(splitting.oversized(df.where("false")))).count() == 0


def test_file_ranges(spark, tmp_path):
    texts = ["Ein Satz mit Wörtern. 系统会切换。\n\n" * 900, "w " * 2400 + "\n" * 3000 + "v " * 4000 + "终。", "short", ""]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_text(t, encoding="utf-8")
    for block in (1111, 1 << 20):
        cut = splitting.file_ranges(spark, str(tmp_path), 500, 50, size=700, block=block).cache()
        out = splitting.piece_texts(cut, splitting.pieces(cut)).orderBy("piece").collect()
        got = {}
        for r in out:
            got.setdefault(r.rec_id, []).append(r)
        assert len(got) == 2
        for rows_ in got.values():
            t = next(x for x in texts if len(x) == rows_[-1].end)
            assert [(r.start, r.end) for r in rows_] == brute_pieces(t, 500, 50, 700)
            assert all(r.text == t[r.start : r.end] for r in rows_)


# ---------------------------------------------------------------- site lines


def test_site_lines_against_brute_force(spark):
    rng = random.Random(2)
    data = []
    for i in range(60):
        lines = [f"Artikel {rng.random()} {rng.random()}", "  Alle  Rechte 20%d " % (i % 7), ""] + (["kurz"] if i % 2 else [])
        data.append((i, rng.choice(["http://www.A.example:80/x", "a.example/y", "HTTPS://b.test"]), "\n".join(lines)))
    data += [(70, None, "kurz"), (71, "", "kurz"), (72, "a.example", None), (0, data[0][1], data[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in data], "ref_id int, url string, body string, site int")

    def site(u):
        return re.sub(r"^www\.", "", re.sub(r":\d*$", "", re.sub(r"[/?#].*$", "", re.sub(r"^[a-z]+://", "", u.lower()))))

    docs, seen = {}, {}
    for i, u, b in data:
        if u and b is not None:
            docs.setdefault(site(u), set()).add(i)
            for n, line in enumerate(b.split("\n"), 1):
                k = re.sub("[0-9]+", "0", " ".join(line.split()).lower())
                if k:
                    seen.setdefault((site(u), k), set()).add((i, n))
    want = sorted({x for (s, _), v in seen.items() if len({i for i, _ in v}) >= 5 and 10 * len({i for i, _ in v}) >= len(docs[s]) for x in v})
    found = site_lines.repeated_lines(df)
    assert rows(found) == want
    clean = {r.ref_id: r.clean for r in site_lines.without_lines(df, found).collect()}
    assert "Rechte" not in clean[0] and clean[72] is None
    assert site_lines.repeated_lines(df.where("false")).count() == 0


def test_chunks_do_not_depend_on_what_is_around():
    line = "the same long notice that stands on every single page of this site, word by word, again and again"
    a = site_lines.chunk_lines("other\n" + line)
    b = site_lines.chunk_lines(line + "\nsomething else")
    assert a[1][1] == b[1][0]
    assert a[2][a[3][1] : a[3][2]].tolist() == b[2][b[3][0] : b[3][1]].tolist()


# ------------------------------------------------------------------ templates


def test_found_records(spark):
    prose = "The privacy node in Farwater met requirement No. 5 and kept its target over the whole period."
    data = [
        (1, "404 Not Found\nGo back to the start page or contact support"), (2, "Home  News\n请启用JavaScript后继续访问"), (3, "Lorem ipsum dolor sit vesti ultra quaerat"),
        (4, f"{prose} Built by {{{{company_name}}}} again."), (5, f"In the chart, {{{{ .Values.replicas }}}} is a variable that the engine replaces. {prose}"),
        (6, f"{prose}\nPlease enable JavaScript for the best experience"), (7, None), (8, ""), (9, f"The proxy logged 404 replies. {prose}"), (10, f"{prose} 由______负责。"),
        (11, prose), (1, "404 Not Found"), (12, f"{prose} The rate is undefined today."),
    ]
    df = spark.createDataFrame([(*r, "u") for r in data], "id int, content string, unit string")
    assert rows(templates.found_ids(df)) == [(1,), (2,), (3,), (4,), (10,), (12,)]
    assert templates.found_ids(df.where("false")).count() == 0


def test_long_units_are_read_whole(spark):
    paragraph = "平台在日常维护中保持服务可用，" + "各节点依次切换并核对数据，" * 40
    link = f"[the start page](/{'x' * 500})"
    notice = "We are very sorry to tell all of our readers, new and old, near and far, on this rainy Tuesday morning in the long month of November, that the page you requested could not, alas, be shown to you at this time."
    df = spark.createDataFrame([(1, paragraph), (2, f"404 Not Found\n{link}"), (3, f"A real sentence stands here, and it is long enough.\n404 Not Found\n{link}"), (4, notice)], "id int, content string")
    assert rows(templates.found_ids(df)) == [(2,), (4,)]


UNSEEN = ["HTTP 503: upstream connect error or disconnect/reset before headers", "Enable JavaScript and cookies to continue", "Sorry, you have been blocked.", "La página que buscas no existe.", "Pagina non trovata", "페이지를 찾을 수 없습니다", "Our systems have detected unusual traffic from your network"]
ORDINARY = ["He answered: None of these were read.", "Null results were [redacted] in the report.", "The N/A column is empty.", "See [Smith et al.] for more.", "Access control is distributed over several servers.", "The robot serves 12 pages an hour."]


def test_notices_in_other_words(spark):
    df = spark.createDataFrame(list(enumerate(UNSEEN + ORDINARY)), "id int, content string")
    assert rows(templates.found_ids(df)) == [(i,) for i in range(len(UNSEEN))]


def test_a_messages_company_decides(spark):
    """A notice in words of no list, on many records without anything else; a notice
    of the list that stands on every page of a site."""
    article = "Ein Absatz über das Kraftwerk Nummer {0} steht hier, und er ist lang genug für einen Artikel. " * 4
    data = [(i, f"Weiter gehts bald.\nKonto {i}") for i in range(24)] + [(100 + i, article.format("abcdefghijklmnopqrstuv"[i]) + "\nVerify you are human") for i in range(22)] + [(200, "Kurzer Satz über Pumpen.\nVerify you are human")]
    df = spark.createDataFrame(data, "id int, content string")
    assert rows(templates.found_ids(df)) == [(i,) for i in range(24)]


def test_a_word_is_a_slot_where_the_template_has_values(spark):
    data = [(i, f"The pilot plant in {town} ran for ninety days without interruption at all.") for i, town in enumerate(["Redpine", "North Azure", "Cloudbrook", "null"])] + [(9, "In the field notes the old word null occurs once.")]
    df = spark.createDataFrame(data, "id int, content string")
    assert rows(templates.found_ids(df)) == [(3,)]


# ---------------------------------------------------------------- boilerplate


def page(i):
    body = "\n".join(f"Absatz {i} {k} mit vielen Wörtern, die hier stehen bleiben sollen." for k in range(4))
    return f"[Home](/a{i})\n[Kontakt](/b{i})\nTitel {chr(65 + i % 20)}\nVon Uwe Drachtel, 2022-01-0{1 + i % 9}\n\n{body}\nMeistgelesen\n* Anderer Titel {i}\n* Noch einer\n© 2020 Velmont\n"


def test_marginals_equal_enumeration():
    """Sum-product against all zone assignments of a short page."""
    import itertools

    labelled = [(p, boilerplate.zones(p.kinds)) for i in range(30) for p in [boilerplate.read(page(i), f"Titel {chr(65 + i % 20)}")]]
    m = boilerplate.Model(labelled)
    p = boilerplate.read("[Home](/a1)\nTitel A\n\nEin Satz hier.\n© 2020 Velmont", "Titel A")
    spine = boilerplate.runs(p.kinds, p.gaps)
    odds = m.chrome_odds(np.array(p.keys))
    e = np.stack([1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(odds))], 1)
    total, content = 0.0, np.zeros(len(p.kinds))
    for zs in itertools.product(range(boilerplate.ZONES), repeat=len(spine)):
        w = np.exp(m.start[zs[0]]) * np.prod([np.exp(m.step[int(p.gaps[spine[g][0]]), zs[g - 1], zs[g]]) for g in range(1, len(spine))])
        per = []
        for (a, b), z in zip(spine, zs):
            for i in range(a, b):
                w *= np.exp(m.emit[z, p.kinds[i]])
                agree = [boilerplate.AGREE if bool(c) == bool(boilerplate.IS_CONTENT[z]) else 1 - boilerplate.AGREE for c in (0, 1)]
                per.append((agree[0] * e[i, 0], agree[1] * e[i, 1]))
        full = w * np.prod([x + y for x, y in per])
        total += full
        content += [full * y / (x + y) for x, y in per]
    assert np.allclose(m.marginals([p])[0], content / total)


def test_a_language_without_training_pages():
    labelled = [(p, boilerplate.zones(p.kinds)) for i in range(60) for p in [boilerplate.read(page(i), f"Titel {chr(65 + i % 20)}")]]
    m = boilerplate.Model(labelled)
    lines = ["Inicio | Noticias | Contacto", "Utilizamos cookies. Aceptar todo", "La nueva central del norte", "Escrito por Ana Ruiz, 2022-03-04", "", "La central abrió sus puertas este martes. Los vecinos esperan menos cortes.", "También te puede interesar", "* Otro artículo sobre nubes", "Suscríbete hoy a nuestro boletín.", "© 2021 Diario. Todos los derechos reservados."]
    p = boilerplate.read("\n".join(lines), "La nueva central del norte")
    kept = [lines[n - 1] for n, x in zip(p.numbers, m.marginals([p])[0]) if x >= 0.5]
    assert kept == [lines[2], lines[5]]


def test_main_content(spark):
    data = [(i, f"Titel {chr(65 + i % 20)}", page(i)) for i in range(60)] + [(90, None, None), (91, "x", ""), (92, None, page(1)), (0, "Titel A", page(0))]
    df = spark.createDataFrame([(*r, 1) for r in data], "k long, title string, t string, line_no int")
    model = boilerplate.fit([df])
    cut = {}
    for r in boilerplate.chrome_lines(df, model).distinct().collect():
        cut.setdefault(r.k, set()).add(r.line_no)
    assert all(cut[i] == {1, 2, 4, 10, 11, 12, 13} for i in [*range(60), 92])
    main = {r.k: r.main for r in boilerplate.main_text(df, model).collect()}
    assert main[90] is None and main[91] == "" and main[3].startswith("Titel D\nAbsatz 3 0")
    assert boilerplate.chrome_lines(df.where("false"), boilerplate.fit([df.where("false")])).count() == 0


# ------------------------------------------------------------------- clusters


def bank(n_groups=6, seed=4):
    rng = np.random.default_rng(seed)
    sizes, out, truth, k = (32, 16, 32, 24), [], {}, 0
    centres = [[rng.normal(size=d) for d in sizes] for _ in range(n_groups)]
    for g in range(n_groups):
        for j in range(20 + 30 * g):
            views = [((c / np.linalg.norm(c) + rng.normal(size=len(c)) * 0.3 / np.sqrt(len(c))) * rng.uniform(0.2, 3)).tolist() for c in centres[g]]
            if j % 17 == 0:
                views[j % 4] = None
            elif j % 19 == 0:
                views[j % 4] = [0.0] * sizes[j % 4]
            out.append((k, *views))
            truth[k] = g
            k += 1
    for _ in range(5):
        out.append((k, *[rng.normal(size=d).tolist() for d in sizes]))
        truth[k] = None
        k += 1
    out.append((k, None, None, None, None))
    truth[k] = None
    return out, truth


def test_groups(spark):
    data, truth = bank()
    df = spark.createDataFrame([(*r, 0) for r in [*data, data[0]]], "tuple_id long, vs_emb array<float>, sents_graph_emb array<float>, summarized_emb array<float>, event_emb array<float>, group_id int")
    got = {r.tuple_id: r.group_id for r in clusters.groups(df).collect()}
    first = {g: min(i for i, x in truth.items() if x == g) for g in set(truth.values()) - {None}}
    assert got == {i: None if g is None else first[g] for i, g in truth.items()}
    told = {r.group_id: (r["size"], r.typical) for r in clusters.described(clusters.groups(df)).collect()}
    assert {g: n for g, (n, _) in told.items()} == {first[g]: 20 + 30 * g for g in range(6)}
    assert all(len(t) == 5 and all(got[x] == g for x in t) for g, (_, t) in told.items())
    assert clusters.groups(df.where("false")).count() == 0


def test_groups_beyond_the_sample(spark):
    """Groups too rare for the rows that the mixture is started on, in one block and in several."""
    data, truth = bank()
    df = spark.createDataFrame(data, "tuple_id long, vs_emb array<float>, sents_graph_emb array<float>, summarized_emb array<float>, event_emb array<float>")
    first = {g: min(i for i, x in truth.items() if x == g) for g in set(truth.values()) - {None}}
    for sample in (60, 12):
        got = {r.tuple_id: r.group_id for r in clusters.groups(df, sample=sample).collect()}
        assert got == {i: None if g is None else first[g] for i, g in truth.items()}, sample


def test_more_groups_than_a_fit_begins_with():
    """Many groups for few components at the start; all are found in one block."""
    rng = np.random.default_rng(2)
    sizes, many = [16, 16], 90
    centres = clusters._unit_views(rng.normal(size=(many, 32)), sizes)
    truth = np.repeat(np.arange(many), 14)
    x = clusters._unit_views(centres[truth] + rng.normal(size=(len(truth), 32)) * 0.05, sizes)
    space = clusters.Space.of(x.mean(0), np.cov(x.T), sizes, 16, 1.0)
    n, _, _, direct, _ = clusters.components(x, space, clusters.RIDGE * float(space.spread.mean()), sizes, start=8)
    group = clusters.same_direction(clusters._unit_views(direct, sizes), sizes)
    near = (clusters._unit_views(direct, sizes) @ centres.T).argmax(1)
    assert len(set(group)) == many and set(near) == set(range(many)) and n.sum() == len(x)


@pytest.mark.parametrize("plan", [[15] * 400, [250] * 60 + [4] * 30 + [2] * 10])
def test_groups_of_any_number_and_size(spark, plan):
    """Hundreds of groups, and very small ones beside large ones: recovered whole."""
    rng = np.random.default_rng(1)
    sizes, data, truth = (32, 16, 32, 24), [], []
    for g, n in enumerate(plan):
        centres = [rng.normal(size=d) for d in sizes]
        for _ in range(n):
            data.append((len(data), *[(c / np.linalg.norm(c) + rng.normal(size=len(c)) * 0.3 / np.sqrt(len(c))).tolist() for c in centres]))
            truth.append(g)
    for _ in range(40):
        data.append((len(data), *[rng.normal(size=d).tolist() for d in sizes]))
        truth.append(-1)
    df = spark.createDataFrame(data, "tuple_id long, vs_emb array<float>, sents_graph_emb array<float>, summarized_emb array<float>, event_emb array<float>")
    got = {r.tuple_id: r.group_id for r in clusters.groups(df, sample=5000).collect()}
    first = {g: truth.index(g) for g in set(truth) - {-1}}
    whole = sum(all(got[i] == first[g] for i, x in enumerate(truth) if x == g) for g in first)
    assert whole >= 0.95 * len(plan)
    assert sum(got[i] is not None for i, x in enumerate(truth) if x < 0) <= 2


def test_kinds_of_lines():
    kinds = {"[Home](/a1)": pages.NAV, "Video | Home | News": pages.BAR, "© 2020 Velmont Lab": pages.FOO, "Accept all | Reject all": pages.CON, "相关阅读": pages.REL, "相关阅读: 标题": pages.INL, "Ein ganzer Satz steht hier.": pages.PROSE, "404 Not Found": pages.BAD, "Posted by A on 2020-01-01": pages.BY}
    for line, k in kinds.items():
        assert pages.kind_of(line, pages.shown(line)) == k, line
