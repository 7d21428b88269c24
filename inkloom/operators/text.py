"""Text columns and line predicates (survey F1-F12, F15, F20, F21, F25, F29; P1-P4, P8, P9; U5, W11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
#: Words of a topic that say nothing about it, longest first.
GENERIC = ("技术白皮书", "白皮书", "技术", "发展", "研究", "系统", "平台", "方案")
#: Marks of a navigation block.
NAV_MARKS = ("返回+", "热门推荐", "产品与解决方案", "行业解决方案", "营销资料")
#: Units of a number that says something, and signs between two numbers
#: of a range.
UNITS = ("%", "％", "ms", "Mbps", "Gbps", "GB", "MB", "KB", "GT/s", "秒", "分钟", "小时", "位", "台", "个", "次", "倍", "年", "MPa", "℃", "V", "A", "W", "kW", "MW", "kWh", "平方米", "m²", "Pa")
RANGE_SIGNS = r"~～—\-"
CITATION = r"\[\^(\d+)\]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """One blank for each run of white space, zero-width signs dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"[​﻿]", ""))


def grams(c: Column, n: int, sign: str = HAN) -> Column:
    """All neighbouring ``n`` signs of a kind, by a pattern that looks ahead: linear in
    the text's length, however long a run is."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=({sign}{{{n}}}))"), 1)


def tokens(c: Column) -> Column:
    """Latin words, and one-, two- and three-sign pieces of Han runs."""
    low = F.lower(c)
    latin = F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9_+.\-]+)"))
    single = F.regexp_extract_all(low, F.lit(f"(?<!{HAN})({HAN})(?!{HAN})"))
    return F.concat(latin, single, grams(low, 2), grams(low, 3))


def token_count(c: Column) -> Column:
    """size(tokens(c)) without making the tokens: a run of n > 1 signs has 2n - 3."""
    low = F.lower(c)
    latin = F.size(F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9_+.\-]+)")))
    runs = F.regexp_extract_all(low, F.lit(f"({HAN}+)"))
    return latin + F.aggregate(runs, F.lit(0), lambda s, r: s + F.greatest(2 * F.length(r) - 3, F.lit(1)))


def anchors(topic: Column) -> Column:
    """Distinct lexical anchors of a topic (F8)."""
    core = F.lower(topic)
    for word in GENERIC:
        core = F.replace(core, F.lit(word), F.lit(""))
    latin = F.regexp_extract_all(core, F.lit(r"([a-z][a-z0-9+.\-]{2,})"))
    runs = F.regexp_extract_all(core, F.lit(f"({HAN}+)"))
    han = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 3, F.array(r)).otherwise(grams(r, 2))))
    return F.array_distinct(F.concat(latin, han))


def is_relevant(topic_anchors: Column, text: Column) -> Column:
    """A Latin anchor if the topic has one, else one of up to two anchors or two of more."""
    hit = F.filter(topic_anchors, lambda a: F.contains(F.lower(text), a))
    latin = F.filter(topic_anchors, lambda a: a.rlike("^[a-z]"))
    latin_hit = F.exists(latin, lambda a: F.contains(F.lower(text), a))
    need = F.when(F.size(topic_anchors) <= 2, 1).otherwise(2)
    return F.when(F.size(topic_anchors) == 0, True).when(F.size(latin) > 0, latin_hit).otherwise(F.size(hit) >= need)


def is_boilerplate(c: Column) -> Column:
    """Navigation block."""
    links = F.regexp_count(c, F.lit(r"\[[^\]]+\]\([^\)]+\)"))
    images = F.regexp_count(c, F.lit(r"!\["))
    marked = F.lit(False)
    for m in NAV_MARKS:
        marked = marked | F.contains(c, F.lit(m))
    return (links >= 6) | (images >= 2) | ((links >= 3) & marked)


def script_share(line: Column, script: str) -> Column:
    """Share of a script's letters among visible signs."""
    letters = {"cjk": r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]", "latin": r"\p{IsLatin}", "any": r"\p{L}"}[script]
    visible = F.length(F.regexp_replace(line, r"(?U)\s", ""))
    return F.try_divide(F.regexp_count(line, F.lit(letters)), visible)


def clean_lines(df: DataFrame, key: str, text: str, script: str = "cjk", least: int = 20) -> DataFrame:
    """(``key``, pos, line): lines kept by the page cleaner (P1).  With script 'cjk'
    the Chinese share must reach 0.6 and visible ASCII stay under 0.8; other
    scripts ask for the same share of their letters and skip the ASCII rule."""
    lines = df.select(key, F.posexplode(F.split(text, r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("pos", "line"))
    lines = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\d+[、．.]\s*", ""))
    n = F.length("line")
    digits = F.regexp_count("line", F.lit(r"[\p{Nd}.．。]")) / n
    ascii_ = F.regexp_count("line", F.lit(r"[\x21-\x7e]")) / n
    odd = F.regexp_count("line", F.lit(r"[^\x00-\x7f\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")) / n
    kept = lines.where(n >= least).where(digits <= 0.4).where(script_share(F.col("line"), script) >= 0.6)
    return kept.where((ascii_ <= 0.8) & (odd <= 0.6)) if script == "cjk" else kept


def safe_name(c: Column, size: int = 120, fallback: str = "untitled") -> Column:
    """File name of a title (F1)."""
    s = F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\n\r\t]', "_"), r"\s+", " ")), 1, size)
    return F.when(F.coalesce(s, F.lit("")) == "", fallback).otherwise(s)


def canonical(c: Column) -> Column:
    """Lower case, only digits, Latin letters and Han (F2; full-width forms folded)."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94))
    return F.regexp_replace(F.lower(F.translate(c, wide, plain)), r"[^0-9a-z\x{4e00}-\x{9fff}]", "")


def clean_title(c: Column) -> Column:
    """Heading without numbering."""
    s = F.regexp_replace(c, r"^\s*#+\s*", "")
    s = F.regexp_replace(s, r"^\s*第[一二三四五六七八九十0-9]+[章节部分]\s*", "")
    s = F.regexp_replace(s, r"^\s*[一二三四五六七八九十]+、\s*", "")
    return F.trim(F.regexp_replace(s, r"^\s*[0-9]+(\.[0-9]+)*[.、)]?\s+", ""))


def sentence_parts(c: Column, least: int = 12) -> Column:
    """Pieces behind end marks, of at least ``least`` signs."""
    marked = F.regexp_replace(normalize(c), r"([。！？；.!?])\s*", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def numeric_values(c: Column) -> Column:
    """Numbers that say something: with a unit, sign or point, or from 10 on."""
    one = r"\d+(?:\.\d+)?"
    pattern = rf"(?<!\p{{Alnum}})({one}(?:\+|\s*[{RANGE_SIGNS}]\s*{one})?\s*(?:{'|'.join(UNITS)})?)"
    compact = lambda v: F.translate(F.lower(F.regexp_replace(v, r"\s+", "")), "％～—", "%~-")
    told = lambda v: v.rlike(r"[%a-z℃².+\-~]") | (F.regexp_extract(v, r"^([0-9]+)", 1).cast("decimal(38,0)") >= 10)
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), compact), told)


def citation_ids(c: Column) -> Column:
    """Cited ids in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(CITATION), 1), lambda v: v.cast("int"))


def anonymise(c: Column, names: Sequence[str], by: str = "[NAME]") -> Column:
    """Names replaced without regard to case."""
    import re

    for n in names:
        c = F.regexp_replace(c, "(?i)" + re.escape(n), by.replace("\\", r"\\").replace("$", r"\$"))
    return c


def middle_trim(c: Column, size: int, mark: str = " … ") -> Column:
    """Head and tail of a long text."""
    half = (size - len(mark)) // 2
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit(mark), F.right(c, F.lit(half))))


def char_jaccard(a: Column, b: Column) -> Column:
    """Overlap of two texts' sets of signs."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def tagged(c: Column, tag: str) -> Column:
    """Contents of <tag>…</tag>."""
    return F.regexp_extract_all(c, F.lit(f"(?is)<{tag}>(.*?)</{tag}>"), 1)


def host(url: Column) -> Column:
    """Host without scheme, port and leading www.."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*://)?(?:www\.)?([^/?#:]*)", 1)
    return F.when(h != "", h)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 for null, zero or unequal vectors."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda p, q: (p * q).cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda p: p.cast("double") * p.cast("double"))))
    return F.coalesce(F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b))), F.lit(0.0))


def long_enough(c: Column, least: int = 50) -> Column:
    """Whether a text has at least ``least`` signs without white space at its ends."""
    return F.coalesce(F.length(strip(c)) >= least, F.lit(False))


def ordered_union(*lists: Column) -> Column:
    """Distinct items of several lists in order of first appearance; null lists are
    empty (U5)."""
    return F.array_distinct(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull())))


def token_windows(n: Column, width: int = 510, keep: int = 255) -> Column:
    """array<struct<start, end>> of windows over ``n`` tokens that share ``keep``."""
    step = width - keep
    last = F.greatest(F.lit(0), F.ceil((n - width) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(n, i * step + width).cast("int").alias("end")))


def window_of(n: Column, token: Column, width: int = 510, keep: int = 255) -> Column:
    """(window, offset) of a token's place: the last window that holds it, where it has
    most to its left (W11)."""
    step = width - keep
    last = F.greatest(F.lit(0), F.ceil((n - width) / step).cast("int"))
    at = F.least(last, F.floor(token / step).cast("int"))
    return F.struct(at.alias("window"), (token - at * step).alias("offset"))
