"""Filling fixed-capacity containers with items, by sum-of-squares packing.

Each task packs its own rows online: an item goes to the fill level that makes
the sum of squared counts of partly filled containers least, tracked in one
array by level.  The items of the containers that a task leaves partly filled are
packed a second time by the same rule, together with those of other tasks and the
largest first; the containers still open then stay as they are.  A task's state is
bounded by the capacity and its open containers; of the texts nothing is shuffled,
of the items only those left over, in groups of about ``GROUP``.

Defined results: an item larger than the capacity is cut into full containers
and one rest, no other item is split; items of size 0 (null and empty texts) are
in no container (``container_id`` null); rows repeated under one id are packed as
often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import written
from .tokenizing import FOLDER, NAME, encode

#: Items left over by the tasks that are packed together.
GROUP = 50000
#: Added to the ids of containers of the second round.
SECOND = 1 << 62


class Packer:
    """Sum-of-squares packing into containers of ``capacity``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.items: dict[int, list[tuple[int, int]]] = {}
        self.serial = 0

    def add(self, item: int, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """Places one item; returns the container that it filled, if it did."""
        c, n = self.capacity, self.count
        levels = np.flatnonzero(n[: c - size + 1])
        # moving a container from level h to h + size changes the sum by 2 (N[h + size] - N[h] + 1);
        # level 0 is a new container, level c a full one, neither counts
        change = np.where(levels + size == c, 1 - 2 * n[levels], 2 * (n[np.minimum(levels + size, c)] - n[levels] + 1))
        fresh = 0 if size == c else 2 * n[size] + 1
        if len(levels) and (k := len(levels) - 1 - int(np.argmin(change[::-1]))) >= 0 and change[k] <= fresh:
            level = int(levels[k])
            at = self.open[level].pop()
            n[level] -= 1
        else:
            level, at = 0, self.serial
            self.serial += 1
            self.items[at] = []
        self.items[at].append((item, size))
        if level + size == c:
            return [(at, self.items.pop(at))]
        self.open[level + size].append(at)
        n[level + size] += 1
        return []

    def rest(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """The containers still open."""
        return list(self.items.items())


def again(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers, the largest item placed first."""
    p, out = Packer(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out += p.add(i, sizes[i])
    return [[i for i, _ in held] for _, held in [*out, *p.rest()]]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of (item, start, size) for items given by size: both rounds of the
    operator, as of one task."""
    parts = [(i, s, min(capacity, n - s)) for i, n in enumerate(sizes) for s in range(0, n, capacity)]
    p, out = Packer(capacity), []
    for k, (_, _, n) in enumerate(parts):
        out += p.add(k, n)
    left = [k for _, held in p.rest() for k, _ in held]
    bins = [[k for k, _ in held] for _, held in out] + [[left[i] for i in held] for held in again([parts[k][2] for k in left], capacity)]
    return [[parts[k] for k in held] for held in bins]


def pack_documents(docs: DataFrame, capacities: list[int], folder: str = FOLDER, name: str = NAME, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(capacity, container_id, doc_id, piece, start_token, n_tokens)."""
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    capacities = sorted({c for c in capacities if c and c > 0})
    schema = f"capacity int, container_id long, {key} {kind}, piece int, start_token long, n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        packers = {c: Packer(c) for c in capacities}
        parts: dict[int, tuple] = {}
        serial = 0
        arrow = None

        def rows(c: int, bins: list, left: bool = False) -> list[tuple]:
            return [(c, first + at, *parts.pop(item), size, left) for at, held in bins for item, size in held]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int32(), pa.int64(), arrow, pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["capacity", "container_id", key, "piece", "start_token", "n_tokens", "left"])

        for b in batches:
            arrow = b.schema.field(0).type
            out: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(encode(t, folder, name))
                for c, p in packers.items():
                    if not n:
                        out.append((c, None, k, 0, 0, 0, False))
                    for piece, start in enumerate(range(0, n, c)):
                        parts[serial] = (k, piece, start)
                        out += rows(c, p.add(serial, min(c, n - start)))
                        serial += 1
            yield batch(out)
        if arrow is not None:
            yield batch([row for c, p in packers.items() for row in rows(c, p.rest(), True)])

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece", "container_id"], kind="stable", ignore_index=True)
        bins = again(pdf.n_tokens.tolist(), int(pdf.capacity.iloc[0]))
        held = pdf.iloc[[i for b in bins for i in b]]
        ids = [SECOND | int(pdf.g.iloc[0]) << 32 | n for n, b in enumerate(bins) for _ in b]
        return held.assign(container_id=ids)[["capacity", "container_id", key, "piece", "start_token", "n_tokens"]]

    placed = written(docs.mapInArrow(run, schema + ", left boolean"), "packed")
    left = placed.where("left")
    groups = max(1, -(-left.count() // (group * max(1, len(capacities)))))
    g = F.pmod(F.xxhash64("container_id", key, "piece", "start_token"), F.lit(groups))
    return placed.where("not left").drop("left").unionByName(left.drop("left").withColumn("g", g).groupBy("capacity", "g").applyInPandas(second, schema))
