"""Streams: state carried between batches, windowed features with watermarks, published snapshots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.sequences import MarkovChain
from tidemill.operators.timeseries import Aggregate, _aggregate, _label
from tidemill.sources.tables import FrameStore


def windowed(stream: DataFrame, time: str, cols: Sequence[str], length: str, slide: str | None = None, late: str = "1 hour", by: Sequence[str] = (), operation: Aggregate = "mean") -> DataFrame:
    """Aggregates of tumbling or sliding windows of event time; rows later than ``late`` are left out."""
    agg = _aggregate(operation)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    made = [agg(F.col(c)).alias(f"{_label(operation)}_{c}") for c in cols]
    return stream.withWatermark(time, late).groupBy(window, *by).agg(*made).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *(f"{_label(operation)}_{c}" for c in cols))


def sessions(stream: DataFrame, time: str, gap: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """(by..., start, end, n): sessions parted by gaps of event time."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def chained_stream(stream: DataFrame, chain: MarkovChain, state: str, seq: str, time: str) -> DataFrame:
    """(seq, state, chained_p): the probability of each state by carrying each sequence's vector from batch to batch."""
    kind = dict(stream.dtypes)[seq]

    def carry(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        vector, last = (np.array(kept.get[0]), kept.get[1]) if kept.exists else (None, None)
        for b in batches:
            states = b.sort_values(time)[state].tolist()
            if vector is None:
                p, vector = chain.chained(states)
            else:
                p, vector = chain.chained([last, *states], vector)
                p = p[1:]
            last = states[-1] if states else last
            yield pd.DataFrame({"seq": [key[0]] * len(states), "state": states, "chained_p": p})
        if vector is not None:
            kept.update(([float(x) for x in vector], last))

    return stream.groupBy(seq).applyInPandasWithState(carry, f"seq {kind}, state string, chained_p double", "vector array<double>, last string", "append", GroupStateTimeout.NoTimeout)


def publish(stream: DataFrame, store: FrameStore, name: str, checkpoint: str):
    """Each batch of a stream published as the named frame; gives back the query."""
    return stream.writeStream.foreachBatch(lambda df, _: store.put(df, name)).option("checkpointLocation", checkpoint).start()
