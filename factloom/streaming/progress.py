"""Incremental extraction as a stream: chunks come in, and what is completed isn't done again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.sources.providers import Provider

KEY = ["document_id", "page", "chunk_index"]
KINDS = "document_id string, page int, chunk_index long, evidence_hash string"
PROGRESS = f"{KINDS}, status string, error string, raw string"
#: Of each chunk: the contents that were completed, parted by commas.
STATE = "completed string"


def asked_once(chunks: DataFrame, provider: Provider) -> DataFrame:
    """chunks: KEY, evidence_hash, prompt. The provider's answers ({prompt} -> {raw}) for contents that aren't completed: PROGRESS.

    What is completed is state of the stream, kept by chunk: a batch reads and writes the state of its own chunks alone,
    however many came before. A chunk that fails is asked again when it comes again; so is one with other content."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0].split(",") if state.exists else []
        fresh = pd.concat(list(parts)).drop_duplicates("evidence_hash").sort_values("evidence_hash")
        out = []
        for row in fresh[~fresh.evidence_hash.isin(done)].itertuples():
            try:
                raw, error = provider.run([{"prompt": row.prompt}])[0]["raw"], None
                done.append(row.evidence_hash)
            except Exception as e:  # stays on its chunk
                raw, error = None, f"{type(e).__name__}: {e}"
            out.append((*key, row.evidence_hash, "FAILED" if error else "COMPLETED", error, raw))
        state.update((",".join(done),))
        yield pd.DataFrame(out, columns=[*KEY, "evidence_hash", "status", "error", "raw"])

    return chunks.groupBy(*KEY).applyInPandasWithState(work, PROGRESS, STATE, "append", GroupStateTimeout.NoTimeout)


def run(chunks: DataFrame, path: str, checkpoint: str, provider: Provider) -> StreamingQuery:
    """Streams chunks (KEY, evidence_hash, prompt) through the provider until all that is there now is done. Answers are
    written by batch, each to a folder of its own, so that a batch that is run twice is written once."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return asked_once(chunks, provider).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window of event time; later rows than the watermark are left out. For streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
