"""Windowed counts and the token-stream reader (survey §2.11; windows are an extension)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n); the same plan for batch and stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    n = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("window_start"), "event_type", "n")


def stream(spark: SparkSession, folder: str, schema: str, width: str, out: str, checkpoint: str):
    """Starts the counts over a folder of Parquet files; exactly-once by the sink's log."""
    events = spark.readStream.schema(schema).parquet(folder)
    return tumbling(events, width).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_OPEN = re.compile(r"\[(?:\^\d*)?$")


def held_blocks(chunks: Iterable[str], tags: tuple[str, ...] = ("table", "chart"), close: bool = True) -> Iterator[str]:
    """Chunks of a token stream so that no half-open citation and no part of a
    tagged block is passed on alone (X1); with ``close`` the end passes on the rest."""
    held = ""
    tag = re.compile("<(" + "|".join(tags) + ")>")
    for chunk in chunks:
        held += chunk
        while held:
            m = tag.search(held)
            if m:
                end = f"</{m.group(1)}>"
                if m.start():
                    yield held[: m.start()]
                    held = held[m.start() :]
                at = held.find(end)
                if at < 0:
                    break
                yield held[: at + len(end)]
                held = held[at + len(end) :]
                continue
            cut = len(held)
            if half := _OPEN.search(held):
                cut = half.start()
            lt = held.rfind("<")
            if lt >= 0 and any(f"<{t}>".startswith(held[lt:]) for t in tags):
                cut = min(cut, lt)
            if cut:
                yield held[:cut]
                held = held[cut:]
            break
    if held and close:
        yield held


def whole_blocks(chunks: DataFrame, tags: tuple[str, ...] = ("table", "chart")) -> DataFrame:
    """(reply, seq, text) of a stream of ``chunks`` (reply, seq, chunk, last): what
    ``held_blocks`` passes on, with the held part of each reply as its state, so that a
    block cut by two micro-batches comes out whole (X1).  ``last`` ends a reply and its
    state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        pdf = pd.concat(list(frames)).sort_values("seq")
        ended = bool(pdf["last"].any())
        text = held + "".join(pdf["chunk"])
        done = list(held_blocks([text], tags))
        if ended:
            state.remove() if state.exists else None
        else:  # the last part is what the reader would still hold
            out = "".join(held_blocks([text, ""], tags, close=False))
            state.update((text[len(out) :],))
            done = [out] if out else []
        at = int(pdf["seq"].max())  # parts of a micro-batch keep its last number
        yield pd.DataFrame({"reply": [key[0]] * bool(done), "seq": [at] * bool(done), "text": ["".join(done)] * bool(done)})

    kind = chunks.schema["reply"].dataType.simpleString()
    return chunks.groupBy("reply").applyInPandasWithState(step, f"reply {kind}, seq long, text string", "held string", "append", GroupStateTimeout.NoTimeout)
