"""Lines repeated across one site's documents.

Each body is normalised and cut into chunks by its content, line ends being signs like
any other: a rolling hash over the last WINDOW characters decides where a chunk ends.
Chunks whose two ends are decided within one line are the line's own: they are the same
wherever the line stands.  Distinct documents are counted per (site, chunk); a line is
a candidate unless one of its own chunks is too rare, and an exact count of distinct
documents per (site, line) confirms it.  A repeated line's own chunks are repeated at
least as often as the line, so no line is lost; a line too short for a chunk of its own
is left to the exact count.

Defined results: rows with null or empty url or null body are left out; blank
lines never count; repeated rows of one ``ref_id`` count as one document; a site
counts its distinct documents with a body; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

WINDOW = 4
#: A chunk ends on one of DIVISOR hash values, so chunks have this many characters on average.
DIVISOR = 32
LEAST_DOCS = 5
LEAST_SHARE = 0.1
SALTS = 16
_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_BLANKS, _EDGES, _DIGITS = re.compile(r"[^\S\n]+"), re.compile(r" ?\n ?"), re.compile(r"[0-9]+")


def site_of(url: Column) -> Column:
    """Host in lower case, without scheme, user, port and leading ``www.``; null
    where there is none."""
    s = F.lower(F.regexp_replace(url, r"^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"^(?:[a-z][a-z0-9+.\-]*:)?//", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[/?#\\].*$", ""), r"^.*@", "")
    s = F.regexp_replace(F.regexp_replace(s, r":\d*$", ""), r"^www\.", "")
    return F.when(s != "", s)


def normal(text: str) -> str:
    """All lines of ``text`` as they are compared."""
    return _DIGITS.sub("0", _EDGES.sub("\n", _BLANKS.sub(" ", text.lower()))).strip(" ")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_lines(text: str, window: int = WINDOW, divisor: int = DIVISOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-blank line of normalised ``text``: its number from 0, its key,
    and, over all lines, the hashes of their own chunks with the offsets of each line's."""
    codes = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    feed = codes == 10
    value = mix(codes.astype(np.uint64) + np.uint64(0x51ED27))
    rolling = np.zeros(n, np.uint64)
    for j in range(min(window, n)):
        rolling[j:] += value[: n - j] * np.uint64(pow(int(_B), j, 1 << 64))
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _B)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(value * power[:n], dtype=np.uint64)])

    def hashed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
        return mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(seed))

    feeds = np.flatnonzero(feed)
    cut = np.flatnonzero(mix(rolling) % np.uint64(divisor) == 0) + 1  # a chunk ends before these places
    start, stop = cut[:-1], cut[1:]
    line = np.searchsorted(feeds, start, side="right") - 1  # the line that holds a chunk's first sign
    own = (line >= 0) & (line < len(feeds) - 1) & (start - window > feeds[line]) if len(start) else np.zeros(0, bool)
    own &= stop <= feeds[np.minimum(line + 1, len(feeds) - 1)]
    start, stop, line = start[own], stop[own], line[own]
    chunks = hashed(start, stop, 0x7F4A7C15)
    a, b = feeds[:-1] + 1, feeds[1:]
    full = np.flatnonzero(b > a)
    keys = hashed(a[full], b[full], 0x2545F491)
    return full, keys.view(np.int64), chunks.view(np.int64), np.searchsorted(line, np.append(full, n)).astype(np.int32)


def line_table(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """(site, ref_id, line_no, key, chunks) of each non-blank line.  ``site`` is a
    64-bit hash of the host, ``key`` one of the line."""
    kept = docs.select(site_of(F.col("url")).alias("site"), "ref_id", "body").where("site is not null and body is not null and ref_id is not null").withColumn("site", F.xxhash64("site"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                bodies = b.column(2).to_pylist()
                counts = np.array([t.count("\n") + 1 for t in bodies])
                full, keys, chunks, offsets = chunk_lines(normal("\n".join(bodies)), window, divisor)
                first = np.concatenate([[0], np.cumsum(counts)])
                row = np.searchsorted(first, full, side="right") - 1
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array((full - first[row] + 1).astype(np.int32)), pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(chunks))], ["site", "ref_id", "line_no", "key", "chunks"])

    kind = docs.schema["ref_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"site long, ref_id {kind}, line_no int, key long, chunks array<long>")


def site_sizes(docs: DataFrame) -> DataFrame:
    """(site, docs): distinct documents with a body."""
    kept = docs.where("body is not null and ref_id is not null").select(site_of(F.col("url")).alias("site"), "ref_id").where("site is not null")
    return kept.select(F.xxhash64("site").alias("site"), "ref_id").distinct().groupBy("site").agg(F.count("*").alias("docs"))


def repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(ref_id, line_no) of the lines repeated within their site."""
    docs = docs.select("ref_id", "url", "body")
    lines = written(line_table(docs), "site-lines")
    enough = F.greatest(F.lit(least_docs), F.ceil(F.round(F.col("docs") * least_share, 6)))
    sizes = written(site_sizes(docs).select("site", enough.alias("least")).where(F.col("least") > 0), "site-sizes")

    def frequent(rows: DataFrame, key: str) -> DataFrame:
        counted = rows.select("site", key, "ref_id").distinct().groupBy("site", key).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
        return counted.join(sizes, "site").where("n >= least").select("site", key)

    chunks = frequent(lines.select("site", F.explode("chunks").alias("chunk"), "ref_id"), "chunk")
    # a line of fewer rows than documents are asked for needs no look at its chunks
    distinct = lines.groupBy("site", "key").agg(F.first("chunks").alias("chunks"), F.count("*").alias("rows")).where(F.col("rows") >= least_docs).select("site", "key", F.array_distinct("chunks").alias("chunks"))
    parts = distinct.select("site", "key", F.size("chunks").alias("size"), F.explode_outer("chunks").alias("chunk"))
    held = parts.join(chunks.withColumn("often", F.lit(1)), ["site", "chunk"], "left").groupBy("site", "key").agg(F.count("often").alias("n"), F.first("size").alias("size"))
    candidates = held.where("n = size").select("site", "key")

    def salted(keys: DataFrame) -> DataFrame:
        return keys.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))

    spread = lines.select("site", "key", "ref_id", "line_no", F.pmod(F.hash("ref_id", "line_no"), F.lit(SALTS)).alias("salt"))
    open_ = written(spread.join(salted(candidates), ["site", "key", "salt"], "left_semi"), "site-candidates")
    sure = frequent(open_, "key")
    return open_.join(salted(sure), ["site", "key", "salt"], "left_semi").select("ref_id", "line_no").distinct()


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the column ``clean``: the body without its lines in ``found``
    (ref_id, line_no).  A null body stays null."""
    cut = found.groupBy("ref_id").agg(F.collect_set("line_no").alias("_cut"))
    kept = F.array_join(F.filter(F.split("body", "\n"), lambda line, i: ~F.coalesce(F.array_contains(F.col("_cut"), i + 1), F.lit(False))), "\n")
    return docs.drop("clean").join(cut, "ref_id", "left").withColumn("clean", F.when(F.col("body").isNotNull(), kept)).drop("_cut")
