"""Keep-first, fill-down, top-k, ranks and paths (survey W1-W10, W14, W15, W17, W18, T6, T7, T10, T11, J13, J19-J23, U2, H5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key.  The order is carried as a struct and folded by
    min_by, so tasks pre-aggregate and a hot key needs no sort (W1)."""
    cols = df.columns
    picked = df.withColumn("_row", F.struct(*cols)).withColumn("_at", F.struct(*order))
    return picked.groupBy(*keys).agg(F.min_by("_row", "_at").alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in cols])


def fill_down(df: DataFrame, value: Column, partition: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Latest non-null ``value`` up to each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def top_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rn") -> DataFrame:
    """First ``k`` rows of each partition; Spark prunes to k per task first."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def transitions(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(src, dst, n, share): neighbouring pairs and their share of the source."""
    w = Window.partitionBy(*partition).orderBy(*order)
    pairs = df.select(F.col(value).alias("src"), F.lead(value).over(w).alias("dst")).where("src is not null and dst is not null")
    n = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def holm(df: DataFrame, p: str, keys: Sequence[str]) -> DataFrame:
    """Step-down adjusted p values (W8); one row a test, so one sorted task."""
    w = Window.orderBy(p, *keys)
    m = F.count("*").over(Window.partitionBy())
    raw = df.withColumn("_i", F.row_number().over(w)).withColumn("_m", m)
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))
    return raw.withColumn("p_holm", F.max(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_i", "_m")


def dense_ids(df: DataFrame, key: str, first: str) -> DataFrame:
    """(``key``, id): ids from 0 in order of first appearance (W14).  Two passes:
    ranges are numbered by their own count, so no task orders all rows."""
    firsts = df.groupBy(key).agg(F.min(first).alias("_at"))
    placed = firsts.repartitionByRange("_at", key).sortWithinPartitions("_at", key).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    from ..session import kept

    placed = kept(placed, "dense-ids")
    begin = placed.groupBy("_p").agg(F.min("_n").alias("_low"), F.count("*").alias("_rows"))
    offset = begin.withColumn("_before", F.sum("_rows").over(Window.orderBy("_p")) - F.col("_rows")).drop("_rows")
    return placed.join(F.broadcast(offset), "_p").select(key, (F.col("_n") - F.col("_low") + F.col("_before")).alias("id"))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``, its place in order from 0 (W7).  Ranges are numbered by
    their own counts, so no task orders all rows; the rows are written once between."""
    from ..session import kept

    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()), "numbered")
    begin = placed.groupBy("_p").agg(F.min("_n").alias("_low"), F.count("*").alias("_rows"))
    offset = begin.withColumn("_before", F.sum("_rows").over(Window.orderBy("_p")) - F.col("_rows")).drop("_rows")
    return placed.join(F.broadcast(offset), "_p").withColumn(name, F.col("_n") - F.col("_low") + F.col("_before")).drop("_p", "_n", "_low", "_before")


def running_context(df: DataFrame, key: str, seq: str, heading: str, text: str, headings: int = 16, tail: int = 1800) -> DataFrame:
    """``df`` with what a writer of the next section sees: the last headings before it
    and the end of the text so far (W18).  The frame reaches back only as many sections
    as there may be headings, so that a long document costs no more a row."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(-headings, -1)
    return df.withColumns({"context_headings": F.collect_list(heading).over(w), "context_tail": F.right(F.array_join(F.collect_list(text).over(w), "\n"), F.lit(tail))})


def heading_parents(df: DataFrame, doc: str, seq: str, level: str, deepest: int = 4) -> DataFrame:
    """``df`` with parent_seq: the nearest earlier heading of a lower level.
    One running window per level, no self join."""
    w = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, deepest + 1):
        df = df.withColumn(f"_l{k}", F.last(F.when(F.col(level) == k, F.col(seq)), ignorenulls=True).over(w))
    parent = F.greatest(*[F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, deepest + 1)], F.lit(None).cast("int"))
    return df.withColumn("parent_seq", parent).drop(*[f"_l{k}" for k in range(1, deepest + 1)])


def resume(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows still to be done."""
    return df.join(done, list(keys), "left_anti")


def matched_or_fail(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Join to a dimension that must hold every key (J13): a missing key raises."""
    known = dimension.withColumn("_known", F.lit(True))
    joined = df.join(known, key, "left")
    return joined.where(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))).otherwise(True)).drop("_known")


def ids_of_urls(df: DataFrame, key: str, urls: str, references: DataFrame) -> DataFrame:
    """(``key``, ids): sorted distinct ids of the references (url, id) that an array of
    addresses names, whatever their scheme, case of the host or slash at the end (J19)."""
    plain = lambda u: F.regexp_replace(F.regexp_replace(F.lower(F.trim(u)), r"^[a-z][a-z0-9+.\-]*://", ""), r"/+$", "")
    known = references.where("url is not null and url <> ''").select(plain(F.col("url")).alias("_u"), "id").distinct()
    each = df.select(key, F.explode(urls).alias("_u")).where("_u is not null and _u <> ''").select(key, plain(F.col("_u")).alias("_u")).distinct()
    return each.join(known, "_u").groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def offset_ids(df: DataFrame, group: str, query: Sequence[str], rank: str, name: str = "id") -> DataFrame:
    """``df`` with ids from 1 that run on over a group's queries: the number of results of
    the queries before, and the rank in its own (H5).  Counts are summed, not rows."""
    n = df.groupBy(group, *query).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(*query).rowsBetween(Window.unboundedPreceding, -1)
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(group, *query).orderBy(rank))
    return df.withColumn("_own", own).join(before, [group, *query]).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before")
