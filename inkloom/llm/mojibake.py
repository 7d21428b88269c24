"""Garbled text from wrong character encoding.

For each pair (legacy encoding it was read with, encoding it was written in) the
characters are mapped back to legacy bytes, an automaton over the bytes finds the
maximal well-formed multibyte spans, and only those spans are decoded.  A span
counts if its length, its surroundings and what it decodes to rule out that
correct text forms it by chance; rare but correct letters, signs and scripts
stay.  Replacement characters and C1 controls show stretches that cannot be
restored wholly; they count as found and stay as they are.

Defined results: null and empty contents are no case and stay null or empty; an
id is found if any of its rows is; restoring is repeated for text garbled twice;
extra columns are kept by ``restored`` and ignored by ``garbled_ids``.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Encodings of one byte a sign that UTF-8 may have been read with.
SINGLE = ("cp1252", "mac_roman", "cp1251", "koi8_r", "cp437", "cp850", "cp1250", "cp866", "cp1253", "cp1257", "mac_cyrillic")
#: Such encodings whose signs 80-9F are controls: only tried on texts that have these.
CONTROLS = ("iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15")
#: Encodings of one or two bytes that UTF-8 may have been read with.
DOUBLE = ("gbk", "big5", "cp932", "euc_kr")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
#: Signs that stand beside letters in correct text of any language.
_BESIDE = set("\xa0«»°·…’‘“”–—•‹›€™©®§№ ")


def _cp1252(b: int) -> str:
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


@functools.cache
def _single(codec: str) -> tuple[dict[int, int], re.Pattern]:
    """(sign -> byte of the encoding's upper half, pattern of a UTF-8 sequence in
    its signs)."""
    upper = {b: _cp1252(b) if codec == "cp1252" else bytes([b]).decode(codec, "replace") for b in range(0x80, 0x100)}
    if codec == "cp1252":  # and ISO 8859-1, whose signs 80-9F are controls
        back = {ord(c): b for b, c in upper.items()} | {b: b for b in range(0x80, 0x100)}
    else:
        back = {ord(c): b for b, c in upper.items() if c != "�"}

    def of(low: int, high: int) -> str:
        return "[" + "".join(re.escape(chr(c)) for c, b in back.items() if low <= b <= high) + "]"

    more = of(0x80, 0xBF)
    one = f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF3)}{more}{{3}})"
    return back, re.compile(f"{one}+")


@functools.cache
def _common() -> frozenset[str]:
    """Han of the first level of the Chinese and Japanese standards, by their rows."""
    rows = [bytes([a, b]) for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)]
    jis = [bytes([a, b]) for a in range(0xB0, 0xD0) for b in range(0xA1, 0xFF)]
    return frozenset("".join(x.decode("gb2312", "ignore") for x in rows)) | frozenset("".join(x.decode("euc_jp", "ignore") for x in jis))


def _likely(c: str) -> bool:
    """A sign that garbled text is likely to stand for."""
    n = ord(c)
    return 0x80 <= n <= 0x17F or n in (0x192, 0x2C6, 0x2DC) or 0x384 <= n <= 0x3CE or 0xAC00 <= n <= 0xD7A3 or 0x401 <= n <= 0x451 or 0x900 <= n <= 0x97F or 0x2010 <= n <= 0x203A or 0x20A0 <= n <= 0x22FF or 0x2500 <= n <= 0x27BF or 0x3000 <= n <= 0x30FF or 0x4E00 <= n <= 0x9FFF or 0xFF01 <= n <= 0xFF5E or n in (0xFEFF, 0xFFFD) or 0x1F300 <= n <= 0x1FAFF


def _written(c: str) -> bool:
    n = ord(c)
    return c in _common() or 0x3000 <= n <= 0x3003 or 0x3008 <= n <= 0x3011 or 0x3041 <= n <= 0x30FE or 0xFF01 <= n <= 0xFF5E or n in (0x201C, 0x201D, 0x2018, 0x2019, 0x2026, 0x2014, 0xB7, 0x2103)


@functools.cache
def _pair() -> re.Pattern:
    """Two neighbouring signs of any one-byte encoding's upper half: without them
    no such encoding's span can be."""
    upper = {chr(c) for codec in SINGLE + CONTROLS for c in _single(codec)[0]}
    return re.compile("[" + "".join(map(re.escape, sorted(upper))) + "]{2}")


def _all_single(text: str) -> Iterator[tuple[int, int, str]]:
    if _pair().search(text):
        for codec in SINGLE + (CONTROLS if LOST.search(text) else ()):
            yield from _single_spans(text, codec)


def _likely_parts(data: bytes) -> Iterator[tuple[int, int, str]]:
    """Well-formed spans of ``data``, cut where a sign is not likely."""
    for m in _UTF8.finditer(data):
        at, begin, held = m.start(), m.start(), ""
        for c in m.group().decode("utf-8", "replace"):
            n = len(c.encode("utf-8"))
            if _likely(c):
                held += c
            else:
                if held:
                    yield begin, at, held
                begin, held = at + n, ""
            at += n
        if held:
            yield begin, at, held


def _single_spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """Spans that are UTF-8 read with a one-byte encoding.  In a line that holds one
    for certain, every well-formed span of the same encoding counts."""
    back, pattern = _single(codec)
    out, matches = [], list(pattern.finditer(text))
    for m in matches:
        for x, y, now in _likely_parts(m.group().translate(back).encode("latin-1")):
            was = m.group()[x:y]
            a, b = m.start() + x, m.start() + y
            before, after = text[a - 1 : a], text[b : b + 1]
            latin = before.isascii() and before.isalpha() or after.isascii() and after.isalpha() and now[-1:].isalpha()
            stop = 0x2010 <= ord(now[0]) <= 0x203A
            if codec == "cp1252":
                sure = len(now) > 1 or was[0] in "ÂÃ" or was[0] == "â" and was[1] in "€\x80" or LOST.search(was) or len(was) > 2 and not _BESIDE.issuperset(was[1:])
            elif codec in CONTROLS:
                sure = LOST.search(was)
            elif len(now) > 1:
                sure = not all(c in _BESIDE or c.isascii() for c in was) and len(set(was)) > 2 or len(was) > 5
            else:
                sure = len(was) == 3 and stop or latin and now.isalpha() and ord(now) < 0x180 or codec == "mac_roman" and was[0] in "√¬" and ord(now) < 0x180
            if sure:
                out.append((a, b, now))
    if out and len(matches) > 1:
        lines = {text.rfind("\n", 0, a) for a, _, _ in out}
        for m in matches:
            if text.rfind("\n", 0, m.start()) in lines:
                out += [(m.start() + u.start(), m.start() + u.end(), u.group().decode("utf-8", "replace")) for u in _UTF8.finditer(m.group().translate(back).encode("latin-1"))]
    return out


def _beside(text: str, sure: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``sure`` and those of ``more`` that stand beside such a span with no letter and
    no line end between."""
    if not sure or not more:
        return sure
    taken = bytearray(len(text))
    for a, b, _ in sure:
        taken[a:b] = b"\1" * (b - a)
    both = sorted([(*x, True) for x in sure] + [(*x, False) for x in more if taken.find(1, x[0], x[1]) < 0])
    good = [x[3] for x in both]
    for order in (range(1, len(both)), range(len(both) - 2, -1, -1)):
        step = -1 if order.step > 0 else 1
        for i in order:
            if not good[i] and good[i + step]:
                low, high = sorted((both[i][:2], both[i + step][:2]))
                good[i] = not any(c.isalpha() or c == "\n" for c in text[low[1] : high[0]])
    return [x[:3] for x, ok in zip(both, good) if ok]


_LINE = re.compile("[^\n]+")
_THREE = rb"(?:\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf])"
#: Bytes of which one must occur for a span to count: two signs of three bytes,
#: four of Cyrillic, or one of a Western text.
_SIGNAL = re.compile(_THREE + rb"{2}|(?:[\xd0\xd1][\x80-\xbf]){4}")
#: What each signal begins with, quick to search for.
_BEGIN3 = re.compile(rb"[\xe0-\xef][\x80-\xbf]{2}[\xe0-\xef][\x80-\xbf]{2}")
_BEGIN2 = re.compile(rb"[\xd0\xd1][\x80-\xbf][\xd0\xd1][\x80-\xbf][\xd0\xd1][\x80-\xbf][\xd0\xd1]")
_WESTERN = re.compile(rb"(?<![\x80-\xff])(?:[\xc2-\xc5][\x80-\xbf]|\xe2\x80[\x80-\xbf])")
_EAST = re.compile("[\u2e80-\uffff]")
_LETTER = re.compile("[A-Za-z]")


def _western_lines(text: str) -> list[re.Match]:
    """Lines of Latin letters with a few signs of the East between."""
    out = []
    for line in _LINE.finditer(text) if _EAST.search(text) else ():
        own = line.group()
        if 0 < len(own.encode("utf-8", "replace")) - len(own) < 0.7 * len(own) and (east := len(_EAST.findall(own))) and len(_LETTER.findall(own)) >= 4 * east:
            out.append(line)
    return out


def _double_spans(text: str, codec: str, western: list[re.Match]) -> list[tuple[int, int, str]]:
    """Spans that are UTF-8 read with a two-byte encoding."""
    out = []
    known = text.encode(codec, "replace")
    strong = (_BEGIN3.search(known) or _BEGIN2.search(known)) and _SIGNAL.search(known)
    for line in _LINE.finditer(text) if strong else western:
        own = line.group()
        known = own.encode(codec, "replace")
        west = any(w.start() == line.start() for w in western) and _WESTERN.search(known)
        if not west and not (strong and _SIGNAL.search(known)):
            continue
        data, place, ends = [], [], []  # bytes of each sign, to come back from bytes to signs
        for i, c in enumerate(own):
            e = c.encode(codec, "replace") if c != "�" else b"?"
            data.append(e)
            place += [i] * len(e)
            ends += [False] * (len(e) - 1) + [True]
        joined = b"".join(data)
        parts = [(a, b, now) for a, b, now in _likely_parts(joined) if a == 0 or ends[a - 1]]
        inside = {place[k] for a, b, _ in parts for k in range(a, b)}
        west = west and all(i in inside for i, c in enumerate(own) if c >= "\u2e80" and c != "�")
        for a, b, now in parts:
            long3 = sum(ord(c) > 0x7FF for c in now)
            cyrillic = sum(0x401 <= ord(c) <= 0x451 for c in now)
            han = sum("一" <= c <= "鿿" for c in now)
            written = sum(map(_written, now))
            if long3 >= 2 and long3 >= len(now) - 1 and written >= 0.5 * han or cyrillic >= 4 and cyrillic == len(now) or west and all(ord(c) < 0x180 or 0x2010 <= ord(c) <= 0x203A for c in now):
                first, last = place[a], place[b - 1]
                while not ends[b - 1]:  # a sign that also holds the byte behind the span
                    now += chr(joined[b]) if joined[b] < 0x80 else "�"
                    b += 1
                out.append((line.start() + first, line.start() + last + 1, now))
    return out


#: (kind, pattern of a run, encoding it was read with, encoding it was written in)
_RUNS = [
    ("latin", re.compile("[\x80-\xffŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{4,}"), "cp1252", "gbk"),
    ("mac", re.compile("[" + "".join(re.escape(bytes([b]).decode("mac_roman")) for b in range(0x80, 0x100)) + "]{4,}"), "mac_roman", "gbk"),
    ("kana", re.compile("(?:[‚ƒ\x82\x83][ -~\x80-\xffŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]){2,}"), "cp1252", "cp932"),
    ("kana mac", re.compile("(?:[ÇÉ][" + "".join(re.escape(bytes([b]).decode("mac_roman")) for b in range(0x40, 0x100) if b != 0x7F) + "]){2,}"), "mac_roman", "cp932"),
    ("cyrillic", re.compile("[À-ÿ¨¸]{5,}"), "cp1252", "cp1251"),
    ("cyrillic koi", re.compile("[À-ÿ£³]{5,}"), "cp1252", "koi8_r"),
    ("han", re.compile("[‐-‧　-ㄯ一-鿿︰-～①-◿]{3,}"), "big5", "gbk"),
    ("han jp", re.compile("[‐-‧　-ㄯ一-鿿︰-～①-◿]{3,}"), "gbk", "cp932"),
]


#: The same for short runs, which only count beside such a run.
_SHORT = [
    ("cyrillic", re.compile("[À-ÿ¨¸]+"), "cp1252", "cp1251"),
    ("cyrillic", re.compile("[À-ÿ£³]+"), "cp1252", "koi8_r"),
    ("han", re.compile("(?:[\x81-\xfeŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™][@-~\x80-\xfeŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™])+"), "cp1252", "gbk"),
]


@functools.cache
def _to_latin() -> dict[int, int | None]:
    """Signs of cp1252's rows 80-9F as the controls of the same bytes."""
    return {c: b for c, b in _single("cp1252")[0].items() if c > 0xFF}


def _back(run: str, codec: str) -> bytes | None:
    try:
        return run.translate(_to_latin()).encode("latin-1") if codec == "cp1252" else run.encode(codec)
    except UnicodeEncodeError:
        return None


_KANA_LEAD = re.compile("[‚ƒÇÉ\x82\x83]")


@functools.cache
def _dense() -> re.Pattern:
    """Two signs close together that common Chinese and Japanese text has not."""
    rare = "".join(chr(n) for n in range(0x4E00, 0xA000) if chr(n) not in _common()) + "\u3105-\u312f\ufe30-\ufe6b"
    return re.compile(f"[{rare}][^\n]{{0,3}}[{rare}]")


def _run_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of another multibyte encoding than UTF-8."""
    out, sure_of = [], defaultdict(list)
    dense, pair, kana = _dense().search(text), _pair().search(text), _KANA_LEAD.search(text)
    for kind, pattern, codec, target in _RUNS:
        if not (dense if kind.startswith("han") else kana if kind.startswith("kana") else pair):
            continue
        for m in pattern.finditer(text):
            run = m.group()
            if kind.startswith("han"):
                if not _dense().search(run):
                    continue
                out += _han_spans(run, m.start(), codec, target)
                continue
            for cut in (0, 1):  # an odd sign at the end may belong to what follows
                piece = run[: len(run) - cut]
                if (data := _back(piece, codec)) is None:
                    continue
                try:
                    now = data.decode(target)
                except UnicodeDecodeError:
                    continue
                if kind.startswith("cyrillic"):
                    letters = all("а" <= c.lower() <= "я" or c in "Ёё" for c in now)
                    sure = letters and (now[1:].islower() or now.isupper()) and _cost(now) < 12
                elif kind.startswith("kana"):
                    sure = sum("ぁ" <= c <= "ヾ" for c in now) >= 2 and all(map(_written, now))
                else:
                    sure = len(now) >= 2 and sum(map(_written, now)) >= 0.6 * len(now) and sum("一" <= c <= "鿿" for c in now) >= 2
                if sure:
                    out.append((m.start(), m.start() + len(piece), now))
                    sure_of[codec, target].append(out[-1])
                    # a line that the same pair of encodings reads as a whole is garbled as a whole
                    a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
                    b = b if b >= 0 else len(text)
                    if not kind.startswith("cyrillic") and (data := _back(text[a:b], codec)) is not None:
                        try:
                            now = data.decode(target)
                        except UnicodeDecodeError:
                            break
                        if sum(c.isascii() or _written(c) for c in now) >= 0.9 * len(now):
                            out.append((a, b, now))
                    break
    for kind, letters, codec, target in _SHORT:
        more = []
        for m in letters.finditer(text) if sure_of[codec, target] else ():
            if (data := _back(m.group(), codec)) is not None:
                try:
                    now = data.decode(target)
                except UnicodeDecodeError:
                    continue
                if all("а" <= c.lower() <= "я" or c in "Ёё" for c in now) if kind == "cyrillic" else all(map(_written, now)):
                    more.append((m.start(), m.end(), now))
        out += _beside(text, sure_of[codec, target], more) if more else []
    return out


#: Fixed value: Han that Chinese text uses most.
OFTEN = frozenset("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处队南给色光门即保治北造百规热领七海口东导器压志世金增争济阶油思术极交受联什认六共权收证改清己美再采转更单风切打白教速花带安场身车例真务具万每目至达走积示议声报斗完类八离华名确才科张信马节话米整空元况今集温传土许步群广石记需段研界拉林律叫且究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严")


@functools.cache
def _as(codec: str, target: str) -> dict[str, tuple[str, int]]:
    """Sign -> (sign that its two bytes are in the other encoding, weight of evidence)."""
    out = {}
    for n in [*range(0x2010, 0x2028), *range(0x2460, 0x24A0), *range(0x3000, 0x3130), *range(0x4E00, 0xA000), *range(0xFE30, 0xFE70), *range(0xFF01, 0xFF5F)]:
        c = chr(n)
        try:
            now = c.encode(codec).decode(target)
        except UnicodeError:
            continue
        if len(now) != 1:
            continue
        lead = c.encode(codec)[0]
        # rows of the read-as encoding that its own language hardly uses
        unused = lead >= 0xC9 if codec == "big5" else 0x81 <= lead <= 0xA0
        stray = "ㄅ" <= c <= "ㄯ" or "︰" <= c <= "﹫"
        often, was = now in OFTEN or now in "，。、；：“”（）", c in OFTEN or c in "，。、；：“”（）！？"
        if not _written(now) or was and not often:
            w = -2
        elif unused and "一" <= c or stray and often:
            w = 2
        else:
            w = 1 if often and not was else 0
        out[c] = (now, w)
    return out


def _han_spans(run: str, at: int, codec: str, target: str) -> list[tuple[int, int, str]]:
    """Pieces of a run of Han that another encoding reads as common signs: stretches
    of signs whose bytes speak for it, sign by sign."""
    table = _as(codec, target)
    out, i = [], 0
    while i < len(run):
        if run[i] not in table or table[run[i]][1] <= 0:
            i += 1
            continue
        j, score, rare, end, best = i, 0, 0, i, (0, 0)
        while j < len(run) and run[j] in table:
            w = table[run[j]][1]
            if w == -2:
                break
            score += w
            rare += w == 2
            j += 1
            if w > 0:
                end, best = j, (score, rare)
        odd = sum("一" <= c <= "鿿" and c not in _common() for c in run[i:end])
        if best[1] and (best[0] >= 4 or odd >= 2 and end - i >= 2):
            out.append((at + i, at + end, "".join(table[c][0] for c in run[i:end])))
        i = max(j, i + 1)
    return out


#: Fixed value: Russian letters by frequency.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RANK = {c: i for i, c in enumerate(RUSSIAN)}
_SWAPPED = re.compile("[А-ЯЁ]{4,}|[а-яё][А-ЯЁ]{3,}|[А-Яа-яЁё]*[а-яё][А-ЯЁ][А-Яа-яЁё]*")


def _cost(word: str) -> float:
    """Mean rank of a word's letters, with a price for four consonants in a row."""
    low = word.lower()
    return sum(_RANK.get(c, 33) for c in low) / len(low) + 6 * len(re.findall("[бвгджзйклмнпрстфхцчшщъь]{4}", low)) + 6 * (low[:1] in "ьъы")


def _swapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Cyrillic words that one Cyrillic encoding was read as another: their case is
    turned round, and their letters make words only in the other encoding."""
    out = []
    for m in _SWAPPED.finditer(text):
        word = m.group()
        if len(word) < 4:
            continue
        mixed = any(c.islower() for c in word) and any(c.isupper() for c in word[1:])
        tries = []
        for a, b in (("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
            try:
                now = word.encode(a).decode(b)
            except UnicodeError:
                continue
            if now[1:].islower() and all("а" <= c <= "я" or c == "ё" for c in now.lower()):
                tries.append((_cost(now), now))
        if tries and min(tries)[0] + (0 if mixed else 4) < _cost(word):
            out.append((m.start(), m.end(), min(tries)[1]))
    if not out:
        return out
    extended = []
    for a, b in (("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
        sure = [x for x in out if _recoded(text[x[0] : x[1]], a, b) == x[2]]
        more = [(m.start(), m.end(), now) for m in _WORDS.finditer(text) if (now := _recoded(m.group(), a, b)) and (now.islower() or now[1:].islower() and m.group()[1:].isupper())]
        extended += _beside(text, sure, more)
    return extended


_WORDS = re.compile("[А-Яа-яЁё]+")


def _recoded(word: str, codec: str, target: str) -> str | None:
    try:
        now = word.encode(codec).decode(target)
    except UnicodeError:
        return None
    return now if all("а" <= c <= "я" or c == "ё" for c in now.lower()) else None


_CYRILLIC = re.compile("[А-ЯЁ]{3}")
_ANY = re.compile("[^\x00-\x7f]")


def spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, restored) that do not overlap, in order."""
    if not _ANY.search(text):
        return []
    found = list(_all_single(text))
    western = _western_lines(text)
    found += [s for codec in DOUBLE for s in _double_spans(text, codec, western)]
    found += _run_spans(text)
    found += _swapped_spans(text) if _CYRILLIC.search(text) else []
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for a, b, now in sorted(found, key=lambda s: (s[0] - s[1], s[0])):  # the longest first
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, now))
    return sorted(out)


def is_garbled(text: str) -> bool:
    if LOST.search(text):
        return True
    if not _ANY.search(text):
        return False
    western = _western_lines(text)
    if _CYRILLIC.search(text) and _swapped_spans(text):
        return True
    return next(_all_single(text), None) is not None or any(_double_spans(text, c, western) for c in DOUBLE) or bool(_run_spans(text))


def restore(text: str) -> str:
    """Restored line by line until no span is left, however often it was garbled: no
    span crosses a line end, and only lines that changed are looked at again.
    Restoring makes a line shorter or its words likelier; one that comes back to an
    earlier form stops."""
    return "\n".join(line if line.isascii() else _restore_line(line) for line in text.split("\n"))


def _restore_line(text: str) -> str:
    seen = set()
    while text not in seen and (found := spans(text)):
        seen.add(text)
        parts, at = [], 0
        for a, b, now in found:
            parts += [text[at:a], now]
            at = b
        text = "".join([*parts, text[at:]])
    return text


@functools.cache
def _odd() -> re.Pattern:
    """Signs that text in the scripts of the corpus hardly has."""
    rows = [bytes([a, b]) for a in range(0xB0, 0xF8) for b in range(0xA1, 0xFF)]
    usual = set("".join(x.decode("gb2312", "ignore") for x in rows)) | _common()
    han = "".join(chr(n) for n in range(0x4E00, 0xA000) if chr(n) not in usual)
    return re.compile(f"[\x80-\x84\x86-\x9f\u3105-\u312f\uac00-\ud7af\ufe30-\ufe6b\uff61-\uff9f�{han}]")


@functools.cache
def _cluster() -> re.Pattern:
    """Three neighbouring signs of an upper half that are neither Cyrillic nor
    usual punctuation."""
    upper = {chr(c) for codec in SINGLE[:8] for c in _single(codec)[0]}
    upper -= {chr(n) for n in range(0x400, 0x460)} | set("\xa0«»°·…’‘“”„–—•‹›™©®§№")
    return re.compile("[" + "".join(map(re.escape, sorted(upper))) + "]{3}")


def restore_if_odd(text: str) -> str:
    """restore() for readers that only need long damage mended: lines without odd signs
    are taken as they are."""
    if not (_odd().search(text) or _cluster().search(text)):
        return text
    return "\n".join(_restore_line(line) if _odd().search(line) or _cluster().search(line) else line for line in text.split("\n"))


def garbled_ids(results: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(``key``) of the records that hold a garbled stretch."""
    kind = results.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0]).filter(pa.array([is_garbled(t) for t in b.column(1).to_pylist()], pa.bool_()))

    kept = results.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and length(t) > 0")
    return kept.mapInArrow(run, f"k {kind}").distinct().withColumnRenamed("k", key)


def restored(results: DataFrame, text: str = "content") -> DataFrame:
    """``results`` with ``text`` restored as far as it can be."""
    at = results.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now = pa.array([t and restore(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([now if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return results.mapInArrow(run, T.StructType(results.schema.fields))
