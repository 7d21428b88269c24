"""Splitting oversized items at natural boundaries.

An item is worked on in ranges of its characters.  Each range lists the places in
it where a paragraph, line, sentence or word ends; it begins at the first sign that
can be part of no boundary and reads on behind its end up to the next such sign, a
halo that grows with the run of blanks or marks there.  Each range also names its
last good boundary, where it hands over to the next: between two of these places an
item's pieces depend on the two ranges' tables alone.  The tables are stitched per
pair of ranges, pieces are chosen there, the pairs' counts are prefix-summed to
number the pieces, and pieces are put together by offset out of the ranges they
touch.  No task needs the boundaries or the text of a whole item; an item has at
most ``MOST_RANGES`` ranges of ordinary size, a longer one larger ranges.
``file_ranges`` feeds the same steps from byte blocks of files on any file system
that Arrow opens.

Defined results: null texts and items within the limit give no piece; lengths
count code points; a stretch without any boundary is cut at the limit; repeated
rows of an item give its pieces once; extra columns are ignored; a field with
several limits gives pieces for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

RANGE = 16384
#: A range spans this many limits at least.
LIMITS = 16
#: Ranges of an item before they grow with it.
MOST_RANGES = 4096
#: Bytes of a file that one task reads at a time.
BLOCK = 1 << 20
#: A better kind of boundary is preferred as long as it leaves a piece of this share of the limit.
LEAST_FILL = 0.5
_ENDS = re.compile(r"(?P<p>\n[^\S\n]*\n\s*)|(?P<l>\n)|(?P<s>(?:[。！？｡．।॥؟…]+[”»」』）)\]】’]*[^\S\n]*)|(?:[.!?]+[”»」』）)\]】’\"']*[^\S\n]+))|(?P<w>[^\S\n]+)")
_RANK = {"p": 4, "l": 3, "s": 2, "w": 1}
#: A sign that no boundary holds: a range may begin at it.
_PLAIN = re.compile(r"[^\s。！？｡．।॥؟….!?”»」』）)\]】’\"']")
IDS = ["item", "field", "rec_id", "chunk_id", "max_size", "overlap"]


def plain_from(text: str, at: int) -> int:
    """First place from ``at`` on where a range may begin."""
    m = _PLAIN.search(text, at) if at > 0 else None
    return m.start() if m else len(text) if at > 0 else 0


def ends(text: str, base: int, low: int, high: int) -> tuple[list[int], list[int]]:
    """Places behind a boundary with low < place <= high, in characters of the
    item, and their ranks (paragraph 4, line 3, sentence 2, word 1)."""
    at, rank = [], []
    for m in _ENDS.finditer(text):
        if low < (p := base + m.end()) <= high:
            at.append(p)
            rank.append(_RANK[m.lastgroup])
    return at, rank


def choose(at: np.ndarray, rank: np.ndarray, begin: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces that cover an item from ``begin`` to ``stop``; where
    ``begin`` is not the item's start, the first piece begins with an overlap too."""
    overlap = max(0, min(overlap, limit - 1))

    def back(end: int) -> int:
        k = np.searchsorted(at, end - overlap, side="left")
        return int(at[k]) if overlap and k < len(at) and at[k] < end else end - overlap

    start, done = (max(0, back(begin)) if begin else 0), begin
    out = []
    while True:
        if stop - start <= limit:
            out.append((start, stop))
            return out
        low, high = max(done, start + overlap), start + limit
        a, b = np.searchsorted(at, [max(low, start + int(limit * LEAST_FILL)), high], side="right")
        if a == b:
            a = np.searchsorted(at, low, side="right")
        if a < b:
            best = rank[a:b]
            end = int(at[a + np.flatnonzero(best == best.max())[-1]])
        else:
            end = high
        out.append((start, end))
        done = end
        start = max(back(end), start + 1)


def handover(at: np.ndarray, rank: np.ndarray, low: int, stop: int, limit: int) -> int:
    """Where a range whose boundaries lie in low < place <= stop ends its part of the
    pieces: its last boundary of the best kind within a limit of its end."""
    near = np.searchsorted(at, max(low, stop - limit), side="right")
    if near == len(at):
        return stop
    best = rank[near:]
    return int(at[near + np.flatnonzero(best == best.max())[-1]])


def oversized(items: DataFrame) -> DataFrame:
    """``items`` (field, rec_id, chunk_id, text, max_size, overlap) beyond their
    limit, once each, with ``item``, a key of the text in its place."""
    big = items.where("length(text) > max_size and max_size > 0").select("field", "rec_id", "chunk_id", "text", "max_size", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    return big.withColumn("item", F.xxhash64("field", "rec_id", "chunk_id", "text", "max_size", "overlap")).dropDuplicates(["item"])


def span_of(size: int, limit: int, least: int = RANGE) -> int:
    """Characters of a range of an item of ``size`` characters."""
    return max(least, LIMITS * limit, -(-size // MOST_RANGES))


def ranges(big: DataFrame, size: int = RANGE) -> DataFrame:
    """One row per range r: characters ``r * span`` up to the place where the next
    range begins, or ``(r + 1) * span`` if that is further; ``low`` and ``stop`` bound
    the boundaries that are the range's own."""
    kinds = {f.name: f.dataType.simpleString() for f in big.schema}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (t, limit) in enumerate(zip(b.column("text").to_pylist(), b.column("max_size").to_pylist())):
                span = span_of(len(t), limit, size)
                firsts = [plain_from(t, at) for at in range(0, len(t), span)] + [len(t)]
                n = len(firsts) - 1
                parts = [t[r * span : max(firsts[r + 1], (r + 1) * span)] for r in range(n)]
                own = [b.column(c).take(pa.array([i] * n)) for c in IDS]
                long = [pa.array(x, pa.int64()) for x in ([len(t)] * n, [span] * n, range(n), firsts[:-1], firsts[1:])]
                yield pa.RecordBatch.from_arrays([*own, *long, pa.array(parts, pa.string())], [*IDS, "size", "span", "r", "low", "stop", "text"])

    head = ", ".join(f"{c} {kinds[c]}" for c in IDS)
    return big.select(*IDS, "text").mapInArrow(cut, f"{head}, size long, span long, r long, low long, stop long, text string")


def pieces(cut: DataFrame) -> DataFrame:
    """(item, field, rec_id, chunk_id, max_size, piece, start, end, span) by offset."""
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    ids = [*IDS, "size", "span", "r"]
    tables = "at array<long>, rank array<tinyint>"

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, r, span, low, stop, limit, overlap in zip(*(b.column(c).to_pylist() for c in ("text", "r", "span", "low", "stop", "max_size", "overlap"))):
                base = r * span
                at, rank = ends(t[low - base : stop - base], low, low, stop)
                at, rank = np.asarray(at, np.int64), np.asarray(rank, np.int8)
                over = handover(at, rank, low, stop, limit) if low < stop else None
                # what the next range needs of this one's table: all behind the handover, and the overlap before it
                k = np.searchsorted(at, (over or 0) - overlap, side="left") if over is not None else len(at)
                out.append((at.tolist(), rank.tolist(), at[k:].tolist(), rank[k:].tolist(), over))
            cols = list(zip(*out)) or [()] * 5
            kept = [pa.array(x, t) for x, t in zip(cols, (pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in ids), *kept], [*ids, "at", "rank", "later", "later_rank", "over"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for limit, overlap, begin, stop, *lists in zip(*(b.column(c).to_pylist() for c in ("max_size", "overlap", "begin", "end", "later", "later_rank", "at", "rank"))):
                at = np.asarray((lists[0] or []) + lists[2], np.int64)
                rank = np.asarray((lists[1] or []) + lists[3], np.int64)
                rows.append([{"start": s, "end": e} for s, e in choose(at, rank, begin, stop, limit, overlap)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in [*ids[:5], "span", "r"]), pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*ids[:5], "span", "r", "pieces"])

    from pyspark.sql import Window

    head = ", ".join(f"{i} {kinds[i]}" for i in ids)
    found = cut.mapInArrow(detect, f"{head}, {tables}, later array<long>, later_rank array<tinyint>, over long").where("over is not null")
    # a pair of neighbouring ranges: at most MOST_RANGES rows an item, a bounded table each
    w = Window.partitionBy("item").orderBy("r")
    last = F.lead("r").over(w).isNull()
    paired = found.select(
        *ids, "at", "rank", F.lag("later").over(w).alias("later"), F.lag("later_rank").over(w).alias("later_rank"),
        F.coalesce(F.lag("over").over(w), F.lit(0)).alias("begin"), F.when(last, F.col("size")).otherwise(F.col("over")).alias("end"),
    )
    chosen = paired.where("end > begin").mapInArrow(stitch, ", ".join(f"{i} {kinds[i]}" for i in ids[:5]) + ", span long, r long, pieces array<struct<start: bigint, end: bigint>>")
    # numbers by the prefix sums of the pairs' counts
    before = F.coalesce(F.sum(F.size("pieces")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chosen.withColumn("before", before).select(*ids[:5], "span", "before", F.posexplode("pieces").alias("k", "p"))
    return placed.select(*ids[:5], (F.col("before") + F.col("k")).cast("int").alias("piece"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), "span")


def piece_texts(cut: DataFrame, offsets: DataFrame) -> DataFrame:
    """``offsets`` with the text of each piece, out of the ranges it touches."""
    touched = offsets.withColumn("r", F.explode(F.expr("sequence(start div span, (end - 1) div span)")))
    own = cut.select("item", "r", "text")
    part = F.expr("substring(text, cast(greatest(start - r * span, 0) + 1 as int), cast(least(end - r * span, span) - greatest(start - r * span, 0) as int))")
    joined = touched.join(own, ["item", "r"]).withColumn("text", part)
    keys = ["item", "field", "rec_id", "chunk_id", "max_size", "piece", "start", "end"]
    return joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "").alias("text"))


def _open(path: str):
    """A file that can be read from any byte on, on any file system known to Arrow."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    return system.open_input_file(at)


def _start(f, at: int, bytes_: int) -> int:
    """First byte from ``at`` on that begins a character."""
    if 0 < at < bytes_:
        f.seek(at)
        return at + next((i for i, x in enumerate(f.read(min(4, bytes_ - at))) if x & 0xC0 != 0x80), 0)
    return min(at, bytes_)


def file_ranges(spark: SparkSession, paths: list[str] | str, max_size: int, overlap: int, size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """The rows of ``ranges`` for UTF-8 files larger than the limit.

    Spark lists the files, reading nothing.  One pass over the byte blocks counts
    characters, whose prefix sums give each block's place; a second cuts each block
    where ranges begin, and a range that crosses blocks is put together.  A block
    reads on behind its end only as far as a character or a run of blanks goes."""
    from pyspark.sql import Window

    listed = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes")).where("bytes > 0")
    table = listed.select("path", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block})")).alias("k")).repartition("path", "k")

    def read(f, k: int, bytes_: int) -> str:
        a, b = _start(f, k * block, bytes_), _start(f, (k + 1) * block, bytes_)
        f.seek(a)
        return f.read(b - a).decode("utf-8", "replace")

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n = []
            for p, k, bytes_ in zip(pdf.path, pdf.k, pdf.bytes):
                with _open(p) as f:
                    n.append(len(read(f, k, bytes_)))
            yield pdf.assign(n=n)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, k, bytes_, first, total in zip(pdf.path, pdf.k, pdf.bytes, pdf["first"], pdf.total):
                span, rows = span_of(total, max_size, size), []
                with _open(p) as f:
                    t, j = read(f, k, bytes_), k + 1

                    def begins(at: int) -> int:
                        """Where the range of place ``at``, which lies in this block, begins."""
                        nonlocal t, j
                        while True:
                            m = _PLAIN.search(t, at - first) if at else None
                            if m or not at or j * block >= bytes_:
                                return at if not at else first + (m.start() if m else len(t))
                            t, j = t + read(f, j, bytes_), j + 1

                    n = len(t)
                    for r in range(int(first // span), int((first + n - 1) // span) + 1):
                        low, high = max(r * span, first), min((r + 1) * span, first + n)
                        begin = begins(r * span) if r * span >= first else None
                        rows.append((p, r, low, total, span, begin, t[low - first : high - first], None))
                        if begin is not None and begin > r * span and r:  # the range before reads on up to there
                            rows.append((p, r - 1, r * span, total, span, None, None, t[r * span - first : begin - first]))
                yield pd.DataFrame(rows, columns=["path", "r", "a", "size", "span", "begin", "part", "halo"])

    sized = table.mapInPandas(counts, "path string, bytes long, k long, n long")
    w = Window.partitionBy("path").orderBy("k")
    placed = sized.withColumn("first", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("path"))).where(F.col("total") > max_size)
    parts = placed.select("path", "k", "bytes", "first", "total").mapInPandas(cut, "path string, r long, a long, size long, span long, begin long, part string, halo string")
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("a", "part")))), lambda x: x["part"]), ""), F.coalesce(F.max("halo"), F.lit("")))
    whole = parts.groupBy("path", "r", "size", "span").agg(F.max("begin").alias("low"), text.alias("text"))
    after = F.coalesce(F.lead("low").over(Window.partitionBy("path").orderBy("r")), F.col("size"))
    return whole.select(F.xxhash64("path").alias("item"), F.lit("file").alias("field"), F.xxhash64("path").alias("rec_id"), F.lit(-1).alias("chunk_id"), F.lit(max_size).alias("max_size"), F.lit(overlap).alias("overlap"), "size", "span", "r", "low", after.alias("stop"), "text")
