"""Template residue and error-page text.

Lines are cut into units, and units are mined into message templates with a prefix
tree of fixed depth.  A unit's numbers are wildcards: units equal but for them are
one message.  Its nodes in the tree are its first tokens, its last tokens, and both
ends with the middle open; units that share a node are instances of one template,
whatever stands at its open place.

Templates are classified once and their verdicts go to all records that hold them.
A message's class is first read from its words and shape: failed page, chrome or
content.  Then its company over all records decides: a message of many records that
hold hardly anything else is a failed page's, whatever its words; one that mostly
stands beside long content is chrome.  A record is found if it has failed units and
no content.

Slots that were never filled in are looked for separately in every sentence.  Some
notations are never anything else; brackets, words such as None or null, and the
like count where their name says so, where the record has another slot, or where
other records hold the sentence's template with another value in that place.  A
sentence that explains the notation is left alone.

Defined results: null and empty contents are no case; a record is found if any of
its rows is; wrongly decoded text is restored before it is read; extra columns
are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import pages
from .common import written
from .mojibake import restore_if_odd

#: Tokens of a node in the prefix tree; signs of scripts without blanks.
DEPTH, SIGNS = 4, 6
#: Records of a message from which on its company counts.
LEAST_RECORDS = 20
#: Shares of a message's records that have other content: below, it is a failed page's;
#: above, chrome.
ALONE, BESIDE = 0.1, 0.8
#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
SMALL = 200_000
#: Units whose classes a task remembers.
KNOWN = 100_000
_W = r"[A-Za-z_一-鿿぀-ヿऀ-ॿЀ-ӿ][\w.ऀ-ॿ ]{0,30}"
#: Notations that are a slot wherever they stand.  Each begins with a plain sign, so
#: that the search skips from one to the next.
SURE = re.compile(
    rf"\{{\{{ ?[^{{}}\n]{{1,40}}\}}\}}|\{{{_W}\}}|\$[A-Za-z_一-鿿][\w.]{{1,30}}\$|%%{_W}%%|%[A-Za-z_一-鿿]\w{{2,30}}%|@@[^@\n]{{1,30}}@@|____|<%=?[^<>\n]{{1,40}}%>"
    r"|×[×X]+|undefined\b|NaN\b|待补充|此处填写|此处插入|请填写|\[object Object\]"
)
#: Notations that have other uses, and words that stand where a value was never set.
PERHAPS = re.compile(
    rf"__{_W}__|\[\[[^\[\]\n]{{1,30}}\]\]|<{_W}>|【[^】\n]{{1,20}}】|［[^］\n]{{1,20}}］|\[(?!\d)[^\[\]\n]{{1,40}}\](?!\()"
    r"|XX[X×]*|null\b|None\b|N/A\b|TBD\b|TODO\b"
)
# What the name of a slot has in it.
NAMED = re.compile(
    r"_|\.\w|(?-i:^\W*[A-Z]{4,}\W*$)|TBD|TODO|\b(?:your|insert|name|title|date|city|town|country|address|phone|email|company|organi[sz]ation|product|author|value|number|amount|price|metric|unit|figure|table|text|item|user|client|customer|placeholder|here)\b"
    r"|填写|插入|补充|名称|标题|日期|城市|公司|产品|作者|数值|指标|单位|姓名|地址|电话|全称|项目|図|製品|会社|都市|日付|値|名前|назван|город|дата|компани|значени|продукт|автор|имя|नाम|शहर|दिनांक|तारीख|कंपनी|मान|उत्पाद|stadt|datum|firma|wert|produkt|autor|nom\b|ville|société|valeur|produit|auteur",
    re.I,
)
#: Words of a sentence that speaks about the notation.
EXPLAINED = re.compile(r"变量|占位符|渲染|模板引擎|配置文件|variable|placeholder|template engine|platzhalter|ersetzt|remplac|変数|置き換え|プレースホルダ|переменн|подставля|заменя|चर |चर\b|बदल", re.I)
_SENTENCE = re.compile(r"\n+|(?<=[。！？।])|(?<=[.!?…]) +(?=[A-ZÀ-ÞА-Я“«„\[{<$#_@%×X])")
_UNIT = re.compile(r"(?<=[。！？।])\s*|(?<=[.!?])\s+| [-–|] ")
CONTENT, CHROME, FAILED = 0, 1, 2
#: Stands for a slot in a sentence's masked form.
OPEN = ""


def _alone(m: re.Match, sentence: str) -> bool:
    """A notation that stands by itself, not inside a word."""
    first = m.group()[0]
    return not (first.isalpha() or first == "×") or not first.isascii() or not sentence[m.start() - 1 : m.start()].isalnum()


def slots(text: str) -> tuple[bool, list[tuple[str, re.Match]]]:
    """(whether there is a slot for certain, the sentences with what may be one)."""
    if not SURE.search(text) and not PERHAPS.search(text):
        return False, []
    found, perhaps = False, []
    for s in _SENTENCE.split(text):
        if not s or EXPLAINED.search(s):
            continue
        found = found or any(_alone(m, s) for m in SURE.finditer(s))
        for m in PERHAPS.finditer(s):
            if _alone(m, s):
                if NAMED.search(m.group()):
                    found = True
                perhaps.append((s, m))
    return found, perhaps


def has_slot(text: str) -> bool:
    """A slot that shows by itself, outside of an explanation of its notation."""
    return slots(text)[0]


def units(text: str) -> list[str]:
    """Units of a text as they are mined."""
    out = []
    for line in pages.shown_lines(text):
        if line and line[0] == "[":
            out.append(line)
        elif line:
            out += [u for u in _UNIT.split(line) if u]
    return out


def _hash(s: str) -> int:
    n = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def nodes(unit: str) -> tuple[int, int, int]:
    """The unit's nodes in the tree: its first tokens, its last ones, both ends."""
    tokens, depth = unit.split(" "), DEPTH
    if len(tokens) < DEPTH:
        tokens, depth = list(unit), SIGNS
    first, last = tokens[:depth], tokens[-depth:]
    return _hash("\x01" + " ".join(first)), _hash("\x02" + " ".join(last)), _hash("\x03" + " ".join(first[:-1]) + "\x03" + " ".join(last[1:]))


def open_nodes(sentence: str, slot: re.Match) -> list[int]:
    """Nodes of the unit of ``sentence`` that holds ``slot``, as it were with another
    value in its place; none where too little of the sentence is left."""
    masked = pages.shown(sentence[: slot.start()] + OPEN + sentence[slot.end() :])
    unit = next((u for u in _UNIT.split(masked) if u and OPEN in u), "")
    tokens, depth = unit.split(" "), DEPTH
    if len(tokens) < DEPTH:
        tokens, depth = list(unit), SIGNS
    if len(tokens) <= depth:
        return []
    before, after = (OPEN in " ".join(x) for x in (tokens[:depth], tokens[-depth:]))
    own = nodes(unit)
    return ([own[2]] if len(tokens) > 2 * depth - 2 and OPEN not in " ".join(tokens[: depth - 1] + tokens[1 - depth :]) else []) + ([own[1]] if before and not after else []) + ([own[0]] if after and not before else [])


def verdict(unit: str) -> int:
    """Class of a message by its words and shape."""
    failed, cue = pages.read_cues(unit)
    if failed:
        return FAILED
    k = pages.kind_of(unit, unit, cue=cue)
    if k == pages.PROSE and len(unit) < 24 and sum(c > "⺀" for c in unit) < 9:
        return CHROME  # a name with an end mark
    return FAILED if k == pages.BAD else CONTENT if k in (pages.PROSE, pages.LONG, pages.TABLE) else CHROME


def _join_small(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Join with a written table: broadcast behind a check of its rows."""
    return left.join(F.broadcast(right) if right.count() <= SMALL else right, on)


def found_ids(results: DataFrame, least_records: int = LEAST_RECORDS) -> DataFrame:
    """(id) of the records without real content or with an unfilled slot."""
    kept = results.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("k"), F.col("content").alias("t")).where("k is not null and length(t) > 0")
    kind = results.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            slot, perhaps, failed, content, many = [], [], [], [], []
            for t in b.column("t").to_pylist():
                t = restore_if_odd(t)
                sure, maybe = slots(t)
                slot.append(sure)
                perhaps.append([] if sure else [n for s, m in maybe for n in open_nodes(s, m)])
                mined = []
                for u in set(units(t)):
                    if (x := known.get(u)) is None:
                        if len(known) > KNOWN:
                            known.clear()
                        x = known[u] = (_hash(u), *nodes(u), verdict(u))
                    mined.append(x)
                failed.append(sum(x[4] == FAILED for x in mined))
                content.append(sum(x[4] == CONTENT for x in mined))
                many.append(mined)
            ends = pa.array([0, *itertools.accumulate(map(len, many))], pa.int32())
            cols = list(zip(*itertools.chain.from_iterable(many))) or [()] * 5
            each = pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int8())], ["h", "a", "b", "c", "v"])
            counts = [pa.array(failed, pa.int32()), pa.array(content, pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(slot, pa.bool_()), pa.array(perhaps, pa.list_(pa.int64())), *counts, pa.ListArray.from_arrays(ends, each)], ["row", "k", "slot", "perhaps", "failed", "content", "units"])

    schema = f"row long, k {kind}, slot boolean, perhaps array<long>, failed int, content int, units array<struct<h: long, a: long, b: long, c: long, v: tinyint>>"
    records = written(kept.mapInArrow(read, schema), "records")
    each = records.select("row", "content", F.explode("units").alias("u")).select("row", "content", "u.*")

    # a message's company, over all records
    company = F.avg((F.col("content") > (F.col("v") == CONTENT).cast("int")).cast("int"))
    spread = each.groupBy("h").agg(F.count("*").alias("n"), company.alias("company"), F.max("v").alias("v")).where(F.col("n") >= least_records)
    now = F.when((F.col("company") <= ALONE) & (F.col("v") != FAILED), FAILED).when((F.col("company") >= BESIDE) & (F.col("v") == FAILED), CHROME)
    changed = written(spread.withColumn("now", now).where("now is not null").select("h", "now"), "templates")
    moved = _join_small(each.select("row", "h", "v"), changed, "h").groupBy("row").agg(
        F.sum((F.col("now") == FAILED).cast("int") - (F.col("v") == FAILED).cast("int")).alias("more"), F.sum(-(F.col("v") == CONTENT).cast("int")).alias("less")
    )

    # what may be a slot: whether another record holds the template with a value there
    asked = written(records.where(F.size("perhaps") > 0).select(F.col("row").alias("asks"), F.explode("perhaps").alias("node")).distinct(), "perhaps")
    held = each.select("row", F.explode(F.array("a", "b", "c")).alias("node"))
    filled = _join_small(held, asked, "node").where("row <> asks").select(F.col("asks").alias("row")).distinct().withColumn("filled", F.lit(True))
    per = records.select("row", "k", "slot", "failed", "content").join(moved, "row", "left").join(filled, "row", "left")
    bad = (F.col("failed") + F.coalesce("more", F.lit(0)) > 0) & (F.col("content") + F.coalesce("less", F.lit(0)) <= 0)
    return per.where(F.col("slot") | F.coalesce("filled", F.lit(False)) | bad).select(F.col("k").alias("id")).distinct()
