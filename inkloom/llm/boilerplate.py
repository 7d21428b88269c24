"""Page boilerplate mixed with main content.

A page is read as a tree: runs of lines of one kind hang on a spine in page
order, lines hang on their run.  A run has a zone (head, title, byline, article,
inset, heading of related links, these links, foot), a line is content or chrome.  Potentials tie each run
to the one before, kinds to zones, and lines to their run; sum-product messages
up the tree and down again give each line's content marginal, for many pages at
once.

No table has labels, so training pages are labelled by their structure: the place of
their known title, the last prose behind it, and what is repeated on the pages of
their site.  From these the share of chrome of each kind of line is counted, and by
it the zones are set; what a kind's words mean is only a prior for kinds that hardly
occur.  Potentials are counted from the labelled pages; some are counted again
without their title, so that pages lacking one are read as well.  A table of lines
that mostly stand in chrome is learned on the way.

Training reads at most ``sample`` pages a table, those with the least hash of
their id; every page is then judged.  Defined results: null and blank texts have
no line; repeated rows give each line once; extra columns are ignored; with no
page to learn from, the uniform prior keeps every line.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import pages
from .common import bounded_sample
from .mojibake import restore_if_odd as restore
from .site_lines import site_of

SAMPLE = 4000
HEAD, TITLE, BYLINE, ARTICLE, INSET, RELATED_HEAD, RELATED, FOOT = range(8)
ZONES = 8
IS_CONTENT = np.array([0, 1, 0, 1, 0, 0, 0, 0], bool)
#: Prior meaning of kinds, which their place and repetition outweigh.
_CONTENT = (pages.PROSE, pages.LONG, pages.TABLE, pages.HEAD)
_CHROME = (pages.SER, pages.INL, pages.FOO, pages.SCR, pages.CON, pages.BY, pages.NAV, pages.ITEM, pages.CRUMB, pages.BAR, pages.REL)
#: Lines that the prior counts as, pages that a site needs to be learned from, pages on
#: which a line of a site is repeated.
PRIOR, LEAST_PAGES, REPEATED = 20, 10, 3
#: Shares of chrome from which on, and up to which, all lines of a kind are labelled alike.
SURE_CHROME, SURE_CONTENT = 0.75, 0.05
#: A line's label agrees with its run's zone with this probability.
AGREE = 0.95
LEAST_SEEN = 3


@dataclass
class Page:
    """Non-blank lines of a page."""

    numbers: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    gaps: list[bool] = field(default_factory=list)  # a blank line stands before
    keys: list[int] = field(default_factory=list)


def key_of(s: str) -> int:
    n = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def read(text: str, title: str | None) -> Page:
    page, gap, known = Page(), False, pages.titled(title)
    for n, (line, s) in enumerate(zip(text.split("\n"), pages.shown_lines(text)), 1):
        if not s:
            gap = True
            continue
        k = pages.kind_of(line, s, known)
        if k == pages.TITLE:
            known = ""  # the first such line
        page.numbers.append(n)
        page.kinds.append(k)
        page.gaps.append(gap)
        page.keys.append(key_of(s))
        gap = False
    return page


@dataclass
class Signs:
    """What the kinds of lines are, as learned from structure."""

    chrome: frozenset[int]
    content: frozenset[int]
    byline: frozenset[int]


def repeated_on_site(many: list[Page], sites: list[str | None]) -> list[list[bool]]:
    """Which lines of each page occur on several pages of its site."""
    on: dict[tuple, set[int]] = defaultdict(set)
    for i, (p, s) in enumerate(zip(many, sites)):
        if s:
            for k in set(p.keys):
                on[s, k].add(i)
    return [[bool(s) and len(on[s, k]) >= REPEATED for k in p.keys] for p, s in zip(many, sites)]


def learn_signs(many: list[Page], sites: list[str | None], repeated: list[list[bool]]) -> Signs:
    """Share of chrome of each kind over the titled pages of sites with enough pages: a
    line is chrome if it stands before the title or behind the last prose of its own,
    or is repeated on its site."""
    pages_of = Counter(s for s in sites if s)
    n, bad, beside = Counter(), Counter(), Counter()
    for p, s, again in zip(many, sites, repeated):
        if pages.TITLE not in p.kinds or not s or pages_of[s] < LEAST_PAGES:
            continue
        t = p.kinds.index(pages.TITLE)
        last = max((i for i in range(t, len(p.kinds)) if p.kinds[i] in (pages.PROSE, pages.LONG, pages.TABLE) and not again[i]), default=t)
        for i, k in enumerate(p.kinds):
            if i != t:
                n[k] += 1
                bad[k] += i < t or i > last or again[i]
                beside[k] += i == t + 1
    prior = {k: 1.0 for k in _CHROME} | {k: 0.0 for k in _CONTENT}
    share = {k: (bad[k] + PRIOR * prior.get(k, 0.5)) / (n[k] + PRIOR) for k in range(pages.KINDS)}
    chrome = frozenset(k for k, v in share.items() if v >= SURE_CHROME)
    byline = frozenset(k for k in chrome if beside[k] + PRIOR * (k == pages.BY) > 0.5 * (n[k] + PRIOR))
    return Signs(chrome, frozenset(k for k, v in share.items() if v <= SURE_CONTENT), byline)


PRIOR_SIGNS = Signs(frozenset(_CHROME), frozenset(_CONTENT), frozenset([pages.BY]))
_LINKS = frozenset([pages.ITEM, pages.CRUMB, pages.BAR])


def zones(kinds: list[int], repeated: list[bool] | None = None, signs: Signs = PRIOR_SIGNS) -> list[int] | None:
    """Zones of a page whose title is known; None for other pages."""
    if pages.TITLE not in kinds:
        return None
    t = kinds.index(pages.TITLE)
    again = repeated or [False] * len(kinds)
    last = max((i for i in range(t, len(kinds)) if kinds[i] in signs.content and not again[i]), default=t)
    out, now = [HEAD] * t + [TITLE], ARTICLE
    for i in range(t + 1, len(kinds)):
        k = kinds[i]
        cut = k in signs.chrome or again[i] and k not in signs.content
        if k in signs.byline and out[-1] in (TITLE, BYLINE):
            out.append(BYLINE)
        elif i <= last:
            out.append(INSET if cut else ARTICLE)
        elif k == pages.REL or again[i] and i + 1 < len(kinds) and not again[i + 1] and kinds[i + 1] not in signs.chrome - _LINKS:
            out.append(RELATED_HEAD)
            now = RELATED
        else:
            if cut and not (now == RELATED and k in _LINKS and not again[i]):
                now = FOOT
            out.append(now)
    return out


class Model:
    """Log potentials, counted with one pseudo-count."""

    def __init__(self, labelled: list[tuple[Page, list[int]]]):
        self.start = np.ones(ZONES)
        self.step = np.zeros((2, ZONES, ZONES))
        self.emit = np.ones((ZONES, pages.KINDS)) * 0.01
        seen: dict[int, list[int]] = {}
        self.trained = bool(labelled)
        for i, (page, zone) in enumerate(labelled):
            for untitled in (False, True):
                if untitled and i % 3:
                    continue
                kinds = [pages.SHORT if k == pages.TITLE and untitled else k for k in page.kinds]
                before = None
                for a, b in runs(kinds, page.gaps):
                    z = zone[a]
                    self.emit[z, kinds[a]] += b - a
                    if before is None:
                        self.start[z] += 1
                    else:
                        self.step[int(page.gaps[a]), before, z] += 1
                    before = zone[b - 1]
            for k, z in zip(page.keys, zone):
                seen.setdefault(k, [0, 0])[int(IS_CONTENT[z])] += 1
        self.start = np.log(self.start / self.start.sum())
        pooled = self.step.sum(0) + 0.2  # steps over a blank line and others back each other off
        self.step += pooled / pooled.sum(1, keepdims=True)
        self.step = np.log(self.step / self.step.sum(2, keepdims=True))
        self.emit = np.log(self.emit / self.emit.sum(1, keepdims=True))
        known = sorted((k, np.log((c + 0.5) / (o + 0.5))) for k, (c, o) in ((k, v) for k, v in seen.items()) if c + o >= LEAST_SEEN)
        self.keys = np.array([k for k, _ in known], np.int64)
        self.odds = np.clip(np.array([v for _, v in known]), -4, 4)

    def chrome_odds(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.odds[at], 0.0)

    def marginals(self, many: list[Page]) -> list[np.ndarray]:
        """Content marginal of each line of each page."""
        if not self.trained:
            return [np.ones(len(p.kinds)) for p in many]
        order = sorted(range(len(many)), key=lambda i: len(many[i].kinds))
        out: list[np.ndarray] = [np.zeros(0)] * len(many)
        for at in range(0, len(order), 256):
            for i, m in zip(order[at : at + 256], self._together([many[i] for i in order[at : at + 256]])):
                out[i] = m
        return out

    def _together(self, some: list[Page]) -> list[np.ndarray]:
        spines = [runs(p.kinds, p.gaps) for p in some]
        width = max(map(len, spines), default=0)
        sizes = np.array([len(p.kinds) for p in some])
        if not width:
            return [np.zeros(0) for _ in some]
        n = len(some)
        first = np.concatenate([[0], np.cumsum(sizes)])
        kinds = np.fromiter((k for p in some for k in p.kinds), np.int64, first[-1])
        gaps = np.fromiter((g for p in some for g in p.gaps), np.int64, first[-1])
        keys = np.fromiter((k for p in some for k in p.keys), np.int64, first[-1])
        begin = np.fromiter((f + a for f, spine in zip(first, spines) for a, _ in spine), np.int64)
        page = np.repeat(np.arange(n), [len(s) for s in spines])
        run = np.fromiter((g for s in spines for g in range(len(s))), np.int64, len(begin))
        # messages of the lines to their run: sum over a line's label of agreement x evidence
        agree = np.where(IS_CONTENT[:, None] == np.array([False, True]), AGREE, 1 - AGREE)  # zone x label
        odds = self.chrome_odds(keys)
        evidence = np.stack([1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(odds))], 1)
        message = np.log(evidence @ agree.T)
        local = np.zeros((n, width, ZONES))
        gap = np.zeros((n, width), int)
        there = np.zeros((n, width), bool)
        local[page, run] = np.add.reduceat(message + self.emit[:, kinds].T, begin)
        gap[page, run] = gaps[begin]
        there[page, run] = True
        up = np.zeros((n, width, ZONES))
        up[:, 0] = self.start + local[:, 0]
        for g in range(1, width):
            up[:, g] = _sum_log(up[:, g - 1][:, :, None] + self.step[gap[:, g]], 1) + local[:, g]
        down = np.zeros((n, width, ZONES))
        for g in range(width - 2, -1, -1):
            back = _sum_log(self.step[gap[:, g + 1]] + (local[:, g + 1] + down[:, g + 1])[:, None, :], 2)
            down[:, g] = np.where(there[:, g + 1][:, None], back, 0)
        zone = up + down
        zone -= _sum_log(zone, 2)[:, :, None]
        # belief of a line's run without the line's own message, then agreement and evidence
        of_line = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, first[-1])))
        rest = np.exp(zone[page, run][of_line] - message)
        label = (rest @ agree) * evidence
        content = label[:, 1] / label.sum(1)
        return [content[a:b] for a, b in zip(first[:-1], first[1:])]


def _sum_log(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def runs(kinds: list[int], gaps: list[bool]) -> list[tuple[int, int]]:
    """(first, behind the last) of each run of one kind without a blank line."""
    out, a = [], 0
    for i in range(1, len(kinds) + 1):
        if i == len(kinds) or kinds[i] != kinds[a] or gaps[i]:
            out.append((a, i))
            a = i
    return out


def fit(tables: list[DataFrame], sample: int = SAMPLE) -> Model:
    """Model of at most ``sample`` pages of each of ``tables`` (k, title, t[, url])."""
    many: list[Page] = []
    sites: list[str | None] = []
    for n, df in enumerate(tables):
        site = site_of(F.col("url")) if "url" in df.columns else F.lit(None).cast("string")
        rows = bounded_sample(df.where("length(t) > 0 and length(title) > 0 and k is not null"), "k", sample).select("title", "t", site.alias("site")).toPandas()
        many += [read(restore(text), title) for title, text in zip(rows.title, rows.t)]
        sites += [s and f"{n} {s}" for s in rows.site]
    repeated = repeated_on_site(many, sites)
    signs = learn_signs(many, sites, repeated)
    return Model([(p, z) for p, again in zip(many, repeated) if (z := zones(p.kinds, again, signs)) is not None])


def chrome_lines(df: DataFrame, model: Model) -> DataFrame:
    """(k, line_no) of the lines of ``df`` (k, title, t) that are no content."""
    kind = df.schema["k"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                many = [read(restore(t), title) for title, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                rows, numbers = [], []
                for i, (page, m) in enumerate(zip(many, shared.value.marginals(many))):
                    cut = [n for n, p in zip(page.numbers, m) if p < 0.5]
                    rows += [i] * len(cut)
                    numbers += cut
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32())], ["k", "line_no"])

    return df.where("length(t) > 0 and k is not null").select("k", "title", "t").mapInArrow(run, f"k {kind}, line_no int")


def main_text(df: DataFrame, model: Model) -> DataFrame:
    """(k, main) of ``df`` (k, title, t): the content lines in their order."""
    kind = df.schema["k"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            many = [read(restore(t), title) if t else Page() for title, t in zip(b.column(1).to_pylist(), texts)]
            out = []
            for t, page, m in zip(texts, many, shared.value.marginals(many)):
                lines = t.split("\n") if t else []
                out.append(None if t is None else "\n".join(lines[n - 1] for n, p in zip(page.numbers, m) if p >= 0.5))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "main"])

    return df.select("k", "title", "t").mapInArrow(run, f"k {kind}, main string")
