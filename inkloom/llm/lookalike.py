"""Visually identical text with different characters.

Embedded DuckDB runs inside the Arrow partitions: ``nfc_normalize``,
``translate`` and regular expressions bring each text to one form in which
texts that look the same are equal.  Letter case, missing accents, superscripts
and other visible differences stay.

Defined results: a null text has a null form; a text without a visible sign has
the empty form and takes part in no pair; rows repeated under one id count once;
extra columns are never read by the pair query and kept by ``canonical_texts``.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import written

# Letters of other scripts drawn like a Latin letter, and signs
# drawn like an ASCII sign.
ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "ӏ": "l", "Ӏ": "I",
    "ѵ": "v", "Ѵ": "V", "Ԍ": "G", "Ғ": "F", "ү": "y", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ӓ": "ä", "Ӓ": "Ä", "ӧ": "ö", "Ӧ": "Ö",
    # Greek and Coptic
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϳ": "j", "ϲ": "c", "Ϲ": "C", "ό": "ó", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c",
    # Armenian
    "օ": "o", "Օ": "O", "ո": "n", "ս": "u", "Ս": "U", "Տ": "S", "հ": "h", "ց": "g", "զ": "q", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin
    "ɡ": "g", "ɩ": "i", "ƽ": "5", "Ɩ": "I", "ꜱ": "s",
    # signs
    "‐": "-", "‑": "-", "﹣": "-", "⁃": "•", "∙": "·", "⋅": "·", "∶": ":", "ʼ": "’", "⁄": "/", "∕": "/", "∣": "|",
    "µ": "μ", "∆": "Δ", "∑": "Σ", "∏": "Π", "⼀": "一", "゠": "=", "˗": "-", "ꞏ": "·", "・": "·", "؍": "/", "٭": "*", "ʹ": "′", "ˈ": "'", "ǃ": "!", "ꓽ": ":",
}
#: Signs that are drawn as nothing; joiners between emoji are kept, see JOINED.
INVISIBLE = "".join(
    f"\\x{{{a:X}}}-\\x{{{b:X}}}"
    for a, b in ((0, 8), (0xE, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1BCA0, 0x1BCA3), (0xE0000, 0xE0FFF))
)
#: Compatibility tags whose forms are drawn like what they stand for.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>")
#: A joiner between two of these makes one picture of them.
EMOJI = "\\x{2190}-\\x{21FF}\\x{2300}-\\x{23FF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}"
JOINED = "\ue0ff"


@functools.cache
def tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer): one-to-one signs of ``translate`` and the forms that
    stand for several signs, all but ALIKE taken from the Unicode data by rule."""
    one, longer = {}, {}
    for n in range(0x80, sys.maxunicode + 1):
        ch = chr(n)
        if unicodedata.category(ch) == "Zs" and ch != " ":
            one[ch] = " "
            continue
        d = unicodedata.decomposition(ch)
        if not d.startswith("<"):
            continue
        tag, *codes = d.split()
        to = "".join(chr(int(c, 16)) for c in codes)
        name = unicodedata.name(ch, "")
        same = (
            tag in SAME_SHAPE
            or tag == "<font>" and len(to) == 1 and "MATHEMATICAL" not in name
            or tag == "<compat>" and ("LIGATURE" in name or name.startswith(("KANGXI RADICAL", "CJK RADICAL", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")) or "DIGRAPH" in name or name.startswith("LATIN") and " LETTER " in name and len(to) == 2)
            or tag == "<small>"
            or tag in ("<isolated>", "<initial>", "<medial>", "<final>", "<vertical>") and len(to) == 1
        )
        if same and to.strip():
            full = unicodedata.normalize("NFC", "".join(ALIKE.get(c, c) for c in to))
            (one if len(full) == 1 else longer)[ch] = full
    one |= {a: b for a, b in ALIKE.items() if a != b}
    one |= {"\uff9e": "\u3099", "\uff9f": "\u309a"}
    for n in range(0x2E80, 0x2FD6):  # radicals: one decomposition step more where the target is itself mapped
        if (to := one.get(chr(n))) and to in one:
            one[chr(n)] = one[to]
    return "".join(one), "".join(one.values()), longer


@functools.cache
def form_sql(column: str = "text") -> str:
    """The canonical form of ``column`` as a DuckDB expression."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    a, b, longer = tables()
    e = f"nfc_normalize(replace({column}, chr(13) || chr(10), chr(10)))"
    e = f"regexp_replace({e}, '([{EMOJI}][\\x{{FE0E}}\\x{{FE0F}}]?)\\x{{200D}}([{EMOJI}])', '\\1{JOINED}\\2', 'g')"
    e = f"regexp_replace({e}, '[{INVISIBLE}]', '', 'g')"
    e = f"translate({e}, {q(a)}, {q(b)})"
    opened = functools.reduce(lambda t, x: f"replace({t}, {q(x[0])}, {q(x[1])})", longer.items(), "t")
    return f"list_transform([{e}], lambda t: nfc_normalize(CASE WHEN regexp_matches(t, '[{''.join(longer)}]') THEN {opened} ELSE t END))[1]"


def _run(batches: Iterator[pa.RecordBatch], select: str) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    for b in batches:
        con.register("part", pa.Table.from_batches([b]))
        yield from con.sql(select).to_arrow_table().to_batches()
        con.unregister("part")


def canonical_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``canonical`` (a column of that name is replaced)."""
    docs = docs.drop("canonical")
    select = f'SELECT *, {form_sql(chr(34) + text + chr(34))} AS canonical FROM part'
    schema = T.StructType([*docs.schema.fields, T.StructField("canonical", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _run(batches, select)

    return docs.mapInArrow(run, schema)


def lookalike_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, look, spelling): the documents whose look has at least two spellings,
    each with its class and its spelling, both as digests.

    Only digests leave the partitions.  Identical texts are first folded into one
    spelling each, so a text with very many copies costs one row per copy, and nothing
    unless another spelling of it exists."""
    select = f"""SELECT doc_id, md5(f) AS look, md5(text) AS spelling FROM
        (SELECT doc_id, text, {form_sql('text')} AS f FROM part WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        WHERE regexp_matches(f, '[^\\s]')"""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _run(batches, select)

    keys = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, look string, spelling string"), "looks")
    several = keys.select("look", "spelling").distinct().groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    return keys.join(several, "look", "left_semi").select("doc_id", "look", "spelling").distinct()


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b): documents that look the same but differ in characters: the pairs
    that ``lookalike_classes`` stands for.  Pairs of spellings are joined first, each
    then expanded to its members over both sides' own shuffle, so no task holds all
    members of a look."""
    members = written(lookalike_classes(docs), "look-members")
    forms = members.select("look", "spelling").distinct()
    pairs = forms.select("look", F.col("spelling").alias("sa")).join(forms.select("look", F.col("spelling").alias("sb")), "look").where("sa <> sb").select("sa", "sb")
    left = members.select(F.col("doc_id").alias("doc_a"), F.col("spelling").alias("sa"))
    right = members.select(F.col("doc_id").alias("doc_b"), F.col("spelling").alias("sb"))
    return pairs.join(left, "sa").join(right, "sb").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
