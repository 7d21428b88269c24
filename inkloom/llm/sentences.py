"""Sentence units across languages and scripts, in SQL expressions.

Dots that end nothing (abbreviations, initials, decimals, addresses, ordinals,
list marks) are masked by a placeholder of the same length, so positions
stay; terminator patterns per kind of script then set end marks, marks inside
a quotation are taken back, the text is split at the marks, and each piece's
place gives the restored sentence out of the unmasked body.

Defined results: null, empty and blank bodies give no row; a line end always ends
a sentence; repeated rows give each sentence once; positions count code points
from 1; extra columns are ignored.  Control signs of a body that equal the masks
are read as another sign of the same length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The masking placeholder and the end mark are private-use signs.  Classes of signs
# are first brought to one control sign each, so that the patterns test single
# bytes.  Lengths stay.
DOT, END = "\ue000", "\ue001"
# Signs of the Unicode property Sentence_Terminal that end a sentence
# without a blank behind them, by script: Indic, Arabic, Armenian, Ethiopic, Burmese,
# Khmer, Tibetan, Mongolian, Syriac, NKo, and other scripts of Asia and Africa.
TERMINAL = "。！？｡．।॥؟۔։።፧፨။។៕།༎᠃᠉܀܁܂߹᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿⸮꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗"
OPENED, CLOSED, HARD, LOW, HIGH, SOFT = "\x01", "\x02", "\x03", "\x05", "\x06", "\x04"
#: (signs, the sign they are read as)
CLASSES = [("«「『", OPENED), ("”»」』", CLOSED), ("„", LOW), ("“", HIGH), (TERMINAL, HARD), ("‼⁉⁈", "!"), ("⁇", "?"), ("…⋯", SOFT), ("）】", ")"), ("（", "("), ("【", "["), (" 　 ", " "), ("：", ":"), ("\x01\x02\x03\x04\x05\x06\ue000\ue001", "\x7f")]
OPEN, CLOSE = OPENED + LOW + HIGH, CLOSED
# Short forms whose dot never ends a sentence ...
ALWAYS = "Mr|Mrs|Ms|Dr|Prof|Eng|St|Hr|Fr|Sr|Jr|cf|incl|vs|e\\.g|i\\.e|z\\. ?B|d\\. ?h|u\\. ?a|p\\. ex|bzw|ca|Ing|Dipl|Mio|Mrd|zzgl|ggf|vgl|Vgl|inkl|approx|env|Env|напр|см|См|им|ул|проф|акад|инж|डॉ|प्रो|श्री|उदा|z|d|т"
# ... and those whose dot ends none before a number.
BEFORE_NUMBER = "no|No|Nos|nos|Fig|Figs|fig|figs|Sec|sec|Ch|ch|Eq|eq|vol|Vol|pp|p|art|Art|tabl|Tabl|chap|Abb|Tab|Nr|Kap|Bd|Ziff|Abs|рис|Рис|табл|Табл|гл|стр|п|क्र|सं"
#: Words before a German ordinal.
ORDINAL = "[Aa]m|[Vv]om|[Zz]um|[Ii]m|[Dd]er|[Dd]em|[Dd]en"
CAMEL = "\\p{Ll}{1,2}\\p{Lu}"
STRONG = HARD + SOFT + "!?"
BRACKETS = ")\\]"
AFTER = f"\\p{{Lu}}\\p{{Lo}}\\p{{N}}{OPEN}(\\[#$•*{{<"
HAN = "\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af"

#: (pattern, replacement, sign that must occur) in order.
STEPS = [
    (f"{LOW}([^{OPEN}{CLOSE}\\n]*+){HIGH}", f"{OPENED}$1{CLOSED}", LOW),
    ('"([^"\\n]*+)"', f"{OPENED}$1{CLOSED}", '"'),
    # masks: inside of numbers, addresses and names; short forms, initials, ordinals; list marks
    (f"\\.(?=[\\p{{Ll}}\\p{{N}}])(?!{CAMEL})(?<=[\\p{{L}}\\p{{N}}_]\\.)(?<![{HAN}]\\.)", DOT, "."),
    (f"\\.(?:(?<=(?<![\\p{{L}}\\p{{N}}])(?:{ALWAYS})\\.)(?=[^\\n])|(?<=(?<![\\p{{L}}\\p{{N}}])(?:{BEFORE_NUMBER})\\.)(?=\\s?\\p{{N}})|(?<=(?<![\\p{{L}}\\p{{N}}°.])(?<!\\p{{N}} )\\p{{Lu}}\\.)(?=\\s?\\p{{Lu}})|(?<=(?<!\\p{{L}})(?:{ORDINAL}) \\p{{N}}{{1,3}}\\.)(?= \\p{{Lu}}))", DOT, "."),
    ("(?m)^([\\s#*•›>·–-]*(?:\\p{N}{1,3}|\\p{L}|[IVX]{2,5}|[ivx]{2,5}))\\.(?=\\s|\\p{L})", f"$1{DOT}", "."),
    # ends: of a quotation after a colon, or before a new start; behind hard signs,
    # soft signs and single dots
    (f"(:\\s?[{OPEN}][^{OPEN}{CLOSE}\\n]*+(?<=[.{STRONG}] ?){CLOSE}[{BRACKETS}]*+)(?=[ \\t]*+(?:[{AFTER}]|{CAMEL}))(?! *[とって])", f"$1{END}", CLOSE),
    (f"{CLOSE}++[{BRACKETS}]*+(?<=[.{STRONG}] ?{CLOSE}{{1,3}}[{BRACKETS}]{{0,2}})(?=[ \\t]++(?:\\p{{Lu}}|{CAMEL}|[{OPEN}])|[{OPEN}])", f"$0{END}", CLOSE),
    (f"{HARD}[.{STRONG}]*+[{BRACKETS}]*+(?=[ \\t]*+[\\p{{L}}{AFTER}])", f"$0{END}", HARD),
    (f"(?:[!?{SOFT}]|\\.(?=\\.))[.{STRONG}]*+[{BRACKETS}]*+(?=[ \\t]*+(?:[{AFTER}]|{CAMEL}))", f"$0{END}", "."),
    (f"\\.(?:(?<=[\\p{{L}}\\p{{M}}\\p{{N}}%°℃)\\]]\\.)([{BRACKETS}]*+)(?=[ \\t]++(?:[{AFTER}]|{CAMEL}))|(?<=\\p{{Ll}}\\p{{Ll}}\\.|[%)\\]]\\.)(?=\\p{{Lu}}|{CAMEL}|[{OPEN}]|\\p{{Lo}})|(?<=\\p{{N}}\\.)(?=\\p{{Lu}}[\\p{{Ll}}\\s]|[{OPEN}]|\\p{{Lo}})|(?<=\\p{{Lo}}\\.)(?=[{AFTER}]))", f".$1{END}", "."),
    # marks within a quotation
    (f"{END}(?=[^{OPEN}{CLOSE}\\n]*+{CLOSE})", "", CLOSE),
]

#: White space and signs that are drawn as nothing, at the ends of a sentence.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
BLOCK = 48


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def marked(body: str) -> str:
    """SQL expression: ``body`` masked, with END behind each sentence that ends
    inside a line."""
    signs = "".join(c for c, _ in CLASSES)
    e = f"translate({body}, {_lit(signs)}, {_lit(''.join(to * len(c) for c, to in CLASSES))})"
    for pattern, to, needs in STEPS:
        if needs == ".":
            e = f"regexp_replace({e}, {_lit(pattern)}, {_lit(to)})"
        else:
            e = f"transform(array({e}), t -> if(contains(t, {_lit(needs)}), regexp_replace(t, {_lit(pattern)}, {_lit(to)}), t))[0]"
    return e


def sentences(docs: DataFrame, key: str = "ref_id", body: str = "body", text: bool = False) -> DataFrame:
    """(``key``, start_pos, end_pos[, sentence]), one row per sentence of a row."""
    add = "aggregate(x, named_struct('a', 0L, 's', cast(array() as array<bigint>)), (r, p) -> named_struct('a', r.a + length(p), 's', array_append(r.s, r.a)))"
    kept = docs.where(f"{body} rlike '\\\\S'").select(F.col(key), F.col(body).alias("body"), F.expr(f"split({marked(body)}, {_lit(END + '|(?<=' + chr(92) + 'n)')})").alias("parts"))
    # Starts in two levels, blocks of BLOCK pieces: no quadratic array, no shuffle.
    blocks = kept.select(key, "body", F.expr(f"transform(sequence(0, cast((size(parts) - 1) div {BLOCK} as int)), i -> slice(parts, i * {BLOCK} + 1, {BLOCK}))").alias("blocks"))
    sized = blocks.select(key, "body", "blocks", F.expr("transform(blocks, b -> aggregate(b, 0L, (a, p) -> a + length(p)))").alias("x0"))
    begun = sized.select(key, *(["body"] if text else []), F.explode_outer(F.arrays_zip(F.col("blocks").alias("b"), F.expr(add.replace("aggregate(x,", "aggregate(x0,").replace("length(p)", "p") + ".s").alias("at"))).alias("z"))
    rows = begun.select(key, *(["body"] if text else []), F.col("z.at").alias("at"), F.col("z.b").alias("b"), F.expr(add.replace("aggregate(x,", "aggregate(z.b,") + ".s").alias("s"))
    one = rows.select(key, *(["body"] if text else []), "at", F.explode_outer(F.arrays_zip("b", "s")).alias("p"))
    tail = F.expr(f"length(trim(leading {_lit(SPACE)} from p.b))")
    both = F.expr(f"length(trim(both {_lit(SPACE)} from p.b))")
    out = one.select(key, *(["body"] if text else []), (F.col("at") + F.col("p.s") + F.length("p.b") - tail + 1).cast("int").alias("start_pos"), both.alias("n")).where("n > 0")
    out = out.withColumn("end_pos", (F.col("start_pos") + F.col("n") - 1).cast("int")).drop("n")
    return out.withColumn("sentence", F.expr("substring(body, start_pos, end_pos - start_pos + 1)")).drop("body") if text else out

