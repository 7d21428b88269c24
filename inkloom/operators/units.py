"""Subject-verb-object units out of a token table (survey M1-M3, H22, J25).

The rules work on one sentence's tokens (i, text, lemma, pos, dep, head); a parser
is plugged in where one is at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SUBJECTS, PASSIVE, OBJECTS = {"nsubj", "csubj"}, {"nsubjpass", "nsubj:pass"}, {"dobj", "obj", "attr", "oprd", "pobj"}
AGENTS, NEGATION = {"agent", "obl:agent"}, {"neg"}
NEGATING = {"不", "没", "没有", "未", "无", "not", "no", "never", "n't"}


@dataclass(frozen=True)
class Token:
    i: int
    text: str
    lemma: str
    pos: str
    dep: str
    head: int


@dataclass(frozen=True)
class Unit:
    """A unit: subject and object as (text, token numbers) or None."""

    subject: tuple[str, tuple[int, ...]] | None
    verb: str
    verb_i: int
    object: tuple[str, tuple[int, ...]] | None


class Sentence:
    def __init__(self, tokens: Sequence[Token]):
        self.tokens = {t.i: t for t in tokens}
        self.below: dict[int, list[Token]] = {}
        for t in tokens:
            if t.head != t.i:
                self.below.setdefault(t.head, []).append(t)

    def children(self, t: Token, deps: set[str]) -> list[Token]:
        return [c for c in self.below.get(t.i, []) if c.dep in deps]

    def with_conjuncts(self, found: list[Token]) -> list[Token]:
        out = []
        for t in found:
            out.append(t)
            out += self.with_conjuncts([c for c in self.below.get(t.i, []) if c.dep == "conj" and c.pos == t.pos])
        return out

    def span(self, t: Token) -> tuple[str, tuple[int, ...]]:
        """Text of the contiguous part of the subtree around ``t``."""
        inside, todo = {t.i}, [t]
        while todo:
            for c in self.below.get(todo.pop().i, []):
                if c.dep not in ("conj", "cc", "punct") and c.i not in inside:
                    inside.add(c.i)
                    todo.append(c)
        low = high = t.i
        while low - 1 in inside:
            low -= 1
        while high + 1 in inside:
            high += 1
        ids = tuple(range(low, high + 1))
        words = [self.tokens[i].text for i in ids]
        return (" ".join(words) if all(w.isascii() for w in words) else "".join(words)), ids

    def negated(self, t: Token) -> bool:
        return any(c.dep in NEGATION or c.text.lower() in NEGATING for c in self.below.get(t.i, []))

    def verbs(self) -> list[Token]:
        found = [t for t in self.tokens.values() if t.pos == "VERB" and t.dep not in ("aux", "auxpass")]
        return found or [t for t in self.tokens.values() if t.pos in ("VERB", "AUX")] or [t for t in self.tokens.values() if t.dep == "ROOT"][:1]

    def subjects(self, v: Token) -> list[Token]:
        own = self.children(v, SUBJECTS | PASSIVE)
        while not own and v.dep == "conj" and v.head in self.tokens and v.head != v.i:
            v = self.tokens[v.head]
            own = self.children(v, SUBJECTS | PASSIVE)
        return self.with_conjuncts(own)

    def objects(self, v: Token) -> list[Token]:
        own = self.children(v, OBJECTS)
        for p in self.children(v, {"prep"}):
            own += self.children(p, {"pobj"})
        for x in self.children(v, {"xcomp"}):
            own += self.children(x, OBJECTS)
        return self.with_conjuncts(own)

    def units(self) -> list[Unit]:
        out: list[Unit] = []
        for v in self.verbs():
            passive = bool(self.children(v, PASSIVE))
            subjects, objects = self.subjects(v), self.objects(v)
            agents = self.with_conjuncts([a for g in self.children(v, AGENTS) for a in (self.children(g, {"pobj"}) or [g])])
            if passive:
                subjects, objects = agents, subjects
            name = ("!" if self.negated(v) else "") + (v.lemma or v.text)
            for s in subjects or [None]:
                for o in objects or [None]:
                    if s is None and o is None:
                        continue
                    out.append(Unit(s and self.span(s), name, v.i, o and self.span(o)))
        seen, kept = set(), []
        for u in out:
            k = (u.subject and u.subject[0], u.verb, u.object and u.object[0])
            if k not in seen:
                seen.add(k)
                kept.append(u)
        return kept

    def head(self, ids: Sequence[int]) -> str:
        """Lemma of a phrase's head: its root, else its first noun, else its last token."""
        inside = [self.tokens[i] for i in ids if i in self.tokens]
        root = next((t for t in inside if t.head not in ids), None)
        noun = next((t for t in inside if t.pos in ("NOUN", "PROPN")), None)
        best = root if root and root.pos in ("NOUN", "PROPN") else noun or (inside[-1] if inside else None)
        return (best.lemma or best.text) if best else ""


def extract_units(tokens: DataFrame) -> DataFrame:
    """Units of a table of tokens (sent_id, i, text, lemma, pos, dep, head)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Sentence([Token(*r) for r in pdf.sort_values("i")[["i", "text", "lemma", "pos", "dep", "head"]].itertuples(index=False)])
        rows = [(pdf["sent_id"].iloc[0], n, u.subject and u.subject[0], u.verb.lstrip("!"), u.verb.startswith("!"), u.object and u.object[0], s.head(u.object[1]) if u.object else None) for n, u in enumerate(s.units())]
        return pd.DataFrame(rows, columns=["sent_id", "svo_id", "subject", "verb", "negated", "object", "object_head"])

    return tokens.groupBy("sent_id").applyInPandas(run, "sent_id long, svo_id int, subject string, verb string, negated boolean, object string, object_head string")


def parsed(sentences: DataFrame, parser: Callable[[str], list[Token]]) -> DataFrame:
    """Token table of ``sentences`` (sent_id, sentence) by a parser that is loaded in the
    tasks (M1); null sentences have no token."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(s, t.i, t.text, t.lemma, t.pos, t.dep, t.head) for s, text in zip(pdf["sent_id"], pdf["sentence"]) if text for t in parser(text)]
            yield pd.DataFrame(rows, columns=["sent_id", "i", "text", "lemma", "pos", "dep", "head"])

    return sentences.select(F.col("sent_id").cast("long"), "sentence").mapInPandas(run, "sent_id long, i int, text string, lemma string, pos string, dep string, head int")
