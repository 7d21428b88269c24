"""Boundary to language models and the web (survey §2.10 L*, F22, F24, H13, S23-S27, M4, M5, X3, X4).

A client is passed in and called in batches inside the tasks, with retries; the
stub answers by rule, offline, and is no substitute in quality.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Client = Callable[[str], str]


def stub(prompt: str) -> str:
    """Deterministic reply: the prompt's last line, shortened."""
    return prompt.strip().splitlines()[-1][:200] if prompt.strip() else ""


def complete(df: DataFrame, prompt: str, client: Client = stub, name: str = "reply", threads: int = 4, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """``df`` with the reply to each prompt, null after ``tries`` failures.
    Equal prompts are asked once (R4)."""
    def ask(text: str) -> str | None:
        for k in range(tries):
            try:
                return client(text)
            except Exception:  # noqa: BLE001
                time.sleep(wait * 2**k)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                yield pdf.assign(**{name: list(pool.map(ask, pdf[prompt]))})

    # the reply comes back under the prompt's digest, so that prompts are shuffled once
    digest = F.sha2(F.col(prompt), 256).alias("_digest")
    distinct = df.where(F.col(prompt).isNotNull()).groupBy(digest).agg(F.any_value(prompt).alias(prompt))
    replies = distinct.mapInPandas(lambda frames: (f[["_digest", name]] for f in run(frames)), f"_digest string, {name} string")
    return df.withColumn("_digest", digest).join(replies, "_digest", "left").drop("_digest")


def json_object(reply: Column, schema: str) -> Column:
    """Object out of a reply with fences or words around it, or quoted twice."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    plain = F.when(fenced != "", fenced).otherwise(reply)
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(F.regexp_replace(body, r",\s*([}\]])", "$1"), r"[“”]", '"')
    once = F.when(fixed.rlike(r'^\{\s*\\"'), F.regexp_replace(fixed, r'\\"', '"')).otherwise(fixed)
    return F.from_json(F.when(once != "", once), schema)


def scores(reply: Column, metrics: list[str], low: float = 0.0, high: float = 5.0) -> Column:
    """Map metric -> score: by label, else by place; out of range is null."""
    numbers = F.regexp_extract_all(reply, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    pairs = []
    for i, m in enumerate(metrics):
        named = F.regexp_extract(reply, rf"(?i){re.escape(m)}\W*[:：=]\W*([0-9]+(?:\.[0-9]+)?)", 1)
        value = F.coalesce(F.when(named != "", named), F.get(numbers, F.lit(i))).cast("double")
        pairs += [F.lit(m), F.when(value.between(low, high), value)]
    return F.create_map(*pairs)


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """Offline stand-in for a text encoder (M4, M5): signed word hashes, unit length."""
    v = [0.0] * size
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "little")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def visible_text(html: str) -> str:
    """Text of a page's HTML: scripts, styles, comments and tags go."""
    import html as entities

    t = re.sub(r"(?is)<(script|style|nav|noscript)\b.*?</\1>|<!--.*?-->", " ", html)
    t = re.sub(r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", t)
    t = re.sub(r"[^\S\n]+", " ", entities.unescape(re.sub(r"<[^>]+>", "", t)))
    return re.sub(r" *\n *", "\n", t).strip()


def record(value) -> str:
    return json.dumps(value, ensure_ascii=False)


class KeyPool:
    """Keys of a service, used in turn; one that fails rests, and when all have failed
    the last error is raised (S23, S24, X4)."""

    def __init__(self, keys: list[str]):
        if not keys:
            raise ValueError("no keys")
        self.keys, self.at, self.failed = list(keys), 0, set()

    def call(self, ask: Callable[[str], object]) -> object:
        error: Exception | None = None
        for _ in range(len(self.keys)):
            key = self.keys[self.at % len(self.keys)]
            self.at += 1
            if key in self.failed:
                continue
            try:
                return ask(key)
            except Exception as e:  # noqa: BLE001
                self.failed.add(key)
                error = e
        raise error or RuntimeError("all keys have failed")


def searched(queries: DataFrame, query: str, engine: Callable[[str, str], list[dict]], keys: list[str], seen: DataFrame | None = None) -> DataFrame:
    """(``query``, rank, url, title, content, error) of distinct queries by a search engine
    called with a key of the pool, one pool a task (S23, S24); urls in ``seen`` go (J23).
    A query whose keys all failed has one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = KeyPool(keys)
        for pdf in frames:
            rows = []
            for q in pdf[query]:
                try:
                    hits = pool.call(lambda key, q=q: engine(key, q))
                    rows += [(q, i, h.get("url"), h.get("title"), h.get("content"), None) for i, h in enumerate(hits)]
                except Exception as e:  # noqa: BLE001
                    rows.append((q, None, None, None, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=[query, "rank", "url", "title", "content", "error"]).astype({"rank": "Int32"})

    out = queries.select(query).where(F.col(query).isNotNull()).distinct().mapInPandas(run, f"{query} string, rank int, url string, title string, content string, error string")
    return out if seen is None else out.join(seen.select("url").distinct(), "url", "left_anti")


def fetched(keys: DataFrame, key: str, fetch: Callable[[str], str], path: str, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """(``key``, reply) of distinct keys, fetched once: what the table at ``path`` holds
    from earlier runs is not asked for again, new replies are appended to it, and keys
    that failed are asked for by the next run (S26, S27, X3)."""
    spark = keys.sparkSession
    kind = keys.schema[key].dataType.simpleString()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    schema = f"{key} {kind}, reply string"
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    todo = asked.join(spark.read.schema(schema).parquet(path), key, "left_anti") if there else asked

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k in pdf[key]:
                for n in range(tries):
                    try:
                        out.append((k, fetch(k)))
                        break
                    except Exception:  # noqa: BLE001
                        time.sleep(wait * 2**n)
            yield pd.DataFrame(out, columns=[key, "reply"])

    todo.mapInPandas(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(asked, key, "left_semi")


def failures(df: DataFrame, key: str, reason: Column, detail: Column) -> DataFrame:
    """(``key``, reason, detail, at) of the rows with a reason: a side table of what went
    wrong (H13)."""
    return df.where(reason.isNotNull()).select(key, reason.alias("reason"), F.left(detail, F.lit(300)).alias("detail"), F.current_timestamp().alias("at"))


def quoted_children(children: DataFrame, evidence: DataFrame, least: int = 12) -> DataFrame:
    """Children of a section's plan (section, child, quote) whose quote is long enough and
    stands in the section's evidence (section, text), white space apart (L8)."""
    plain = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    held = evidence.groupBy("section").agg(F.collect_list(plain(F.col("text"))).alias("_e"))
    j = children.where(F.length(plain(F.col("quote"))) >= least).join(held, "section")
    return j.where(F.exists("_e", lambda e: F.contains(e, plain(F.col("quote"))))).drop("_e")
