"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts up to ``leaf`` characters are encoded where they are read.  A longer text
is halved again and again into leaves, blocks of which any task may encode; the
halves' ids are then joined pairwise, tree-wise: within the blocks by the tasks
that encode them, then over the blocks.  A cut between two signs of different
classes of the tokenizer's pattern joins by plain concatenation.  A cut inside a
long stretch of one class (letters, digits, blanks or marks) is joined by encoding
a window around it anew, and the window grows until its first id agrees with the
left half's and its last with the right half's.  A BPE encoding is valid exactly if
each two neighbouring ids are, so agreement at both ends makes the joined ids those
of the whole text.

Defined results: null and empty texts give an empty list, rows repeated in the
input give the same row once per occurrence, names of special tokens are
ordinary text, no special tokens are added.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
LEAF = 8192
#: Leaves that one task encodes and joins.
BLOCK = 64
#: Fixed value: the public word pattern of this tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(folder: str = FOLDER, name: str = NAME):
    """The tokenizer, read once per Python worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, folder: str = FOLDER, name: str = NAME) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    return encoder(folder, name).encode_to_numpy(text, disallowed_special=())


#: Fixed value: the signs that the pattern takes as white space.
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LETTER, NUMBER, WHITE, MARK, UNKNOWN = range(5)


@functools.lru_cache(1 << 16)
def class_of(ch: str) -> int:
    """Class of a sign in the pattern.  Signs without an assigned category might be
    classed differently by another version of Unicode: unknown, never cut beside."""
    c = unicodedata.category(ch)
    return WHITE if ch in _WHITE else LETTER if c[0] == "L" else NUMBER if c[0] == "N" else UNKNOWN if c == "Cn" else MARK


def _boundary(text: str, at: int) -> bool:
    """True where a word of the pattern always ends, whatever is around: between two
    classes, but a blank may belong to the word behind it, and so may an apostrophe."""
    a, b = class_of(text[at - 1]), class_of(text[at])
    return a != b and a != WHITE and UNKNOWN not in (a, b) and text[at - 1] != "'"


def _one_class(text: str) -> bool:
    """Only signs of one class: a part of a single word of the pattern."""
    first = class_of(text[0]) if text else UNKNOWN
    return first != UNKNOWN and all(class_of(c) == first for c in text)


def halves(text: str, leaf: int) -> list[tuple[str, bool]]:
    """Leaves of ``text`` in order, each with whether its start is a sure word
    boundary.  Only a stretch of signs of unknown class stays whole."""
    out: list[tuple[str, bool]] = []
    todo = [(0, len(text), True)]
    while todo:
        a, b, sure = todo.pop()
        cut = None
        if b - a > leaf:
            mid, reach = (a + b) // 2, (b - a) // 4
            near = [p for d in range(min(reach, 512)) for p in (mid + d, mid - d)]
            cut = next(((p, True) for p in near if _boundary(text, p)), None)
            if cut is None:
                cut = next(((p, False) for p in near if _one_class(text[p - 32 : p + 33])), None)
            if cut is None:
                cut = next(((p, True) for d in range(512, reach) for p in (mid + d, mid - d) if _boundary(text, p)), None)
        if cut is None:
            out.append((text[a:b], sure))
        else:
            todo += [(cut[0], b, cut[1]), (a, cut[0], sure)]
    return out


def _inside(around: str, data: str) -> bool:
    """Whether the window may be encoded as a part of one word: of blanks, the last of
    a run belongs to the next word, so the run must go on behind the window."""
    return class_of(data[0]) != WHITE or class_of(around[-1]) == WHITE and len(around) > len(data)


def join_ids(left: np.ndarray, right: np.ndarray, sure: bool, enc, start: int = 4) -> np.ndarray:
    """Ids of the concatenated texts of ``left`` and ``right``."""
    if sure or not len(left) or not len(right):
        return np.concatenate([left, right])
    k = start
    while k < min(len(left), len(right)):
        data = enc.decode_bytes([*left[-k:].tolist(), *right[:k].tolist()])
        # one id more on either side shows that the word goes on there, or ends with the window
        around = enc.decode_bytes([*left[-k - 1 :].tolist(), *right[: k + 1].tolist()])
        if not (_one_class(data.decode("utf-8", "ignore")) and _inside(around.decode("utf-8", "ignore"), data.decode("utf-8", "ignore"))):
            break
        window = enc._core_bpe.encode_single_piece(data)
        if len(window) > 1 and window[0] == left[-k] and window[-1] == right[k - 1]:
            return np.concatenate([left[:-k], np.asarray(window, np.uint32), right[k:]])
        k *= 2
    return encode_bytes(enc, enc.decode_bytes(left.tolist()) + enc.decode_bytes(right.tolist()))


def encode_bytes(enc, data: bytes) -> np.ndarray:
    return enc.encode_to_numpy(data.decode("utf-8"), disallowed_special=())


def tree_concat(parts: list[tuple[np.ndarray, bool]], enc) -> np.ndarray:
    """Pairwise joins, level by level."""
    while len(parts) > 1:
        parts = [(join_ids(parts[i][0], parts[i + 1][0], parts[i + 1][1], enc), parts[i][1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0][0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_documents(docs: DataFrame, folder: str = FOLDER, name: str = NAME, leaf: int = LEAF, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ids array<int>) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [encode(t, folder, name) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], [key, "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, k, t in zip(b.column("r").to_pylist(), b.column("k").to_pylist(), b.column("t").to_pylist()):
                cut = halves(t, leaf)
                for at in range(0, len(cut), block):
                    some = cut[at : at + block]
                    yield pa.RecordBatch.from_pydict(
                        {"r": [row], "k": pa.array([k], b.schema.field("k").type), "n": pa.array([at // block], pa.int32()), "more": [len(cut) > block], "sure": pa.array([[s for _, s in some]], pa.list_(pa.bool_())), "t": pa.array([[p for p, _ in some]], pa.list_(pa.string()))}
                    )

    def encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            for i, (sure, t) in enumerate(zip(b.column("sure").to_pylist(), b.column("t").to_pylist())):
                ids = _lists([tree_concat([(encode(p, folder, name), s) for p, s in zip(t, sure)], enc)])
                own = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("r", "k", "n", "more")), pa.array([sure[0]]), ids], ["r", "k", "n", "more", "sure", "ids"])

    def concat(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        ids = tree_concat([(np.asarray(i, np.uint32), bool(s)) for i, s in zip(pdf.ids, pdf.sure)], encoder(folder, name))
        return pd.DataFrame({key: pdf.k.iloc[:1].tolist(), "ids": [ids.astype(np.int32)]})

    out = f"{key} {kind}, ids array<int>"
    here = docs.where(F.coalesce(F.length("t"), F.lit(0)) <= leaf).mapInArrow(short, out)
    long = docs.where(F.length("t") > leaf).select(F.monotonically_increasing_id().alias("r"), "k", "t")
    leaves = long.mapInArrow(split, f"r long, k {kind}, n int, more boolean, sure array<boolean>, t array<string>")
    blocks = leaves.repartition("r", "n").mapInArrow(encode_blocks, f"r long, k {kind}, n int, more boolean, sure boolean, ids array<int>")
    return here.unionByName(blocks.groupBy("r").applyInPandas(concat, out))
