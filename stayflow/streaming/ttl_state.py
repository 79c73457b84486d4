"""Keys with a lifetime in wall-clock time, held in the state store (RocksDB) of a streaming query.

The state is one small value per key and expires by itself. Processing-time expiry keeps a query scheduling
batches, so these queries run with a processing-time trigger until they are stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stayflow import fixed_values as V


class _FirstSeen(StatefulProcessor):
    """Pass the first row of a key and nothing more until the key has expired."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        seen = T.StructType([T.StructField("seen", T.BooleanType())])
        self.seen = handle.getValueState("seen", seen, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        # The other rows of the key are left unread.
        first = next(rows, None)
        if first is not None:
            self.seen.update((True,))
            yield first.head(1)

    def close(self) -> None:
        pass


class _Latest(StatefulProcessor):
    """Remember the value of a key with the greatest order for a while, and pass on each change."""

    def __init__(self, ttl_seconds: int, key: str, value: str, order: str):
        self.ttl_ms, self.key_name, self.value_name, self.order_name = ttl_seconds * 1000, key, value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = T.StructType([T.StructField("value", T.StringType()), T.StructField("place", T.LongType())])
        self.last = handle.getValueState("last", kept, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        before, place = self.last.get() if known else (None, None)
        newest = before
        for frame in rows:
            at = frame[self.order_name].idxmax()
            if place is None or frame[self.order_name][at] >= place:
                newest, place = frame[self.value_name][at], int(frame[self.order_name][at])
        if place is None:
            return
        self.last.update((newest, place))
        if before != newest:
            yield pd.DataFrame({self.key_name: [key[0]], self.value_name: [newest], "known": [known]})

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, keys: list[str], ttl_seconds: int = V.TTL_PROCESSED) -> DataFrame:
    """The first row per key; a key is forgotten `ttl_seconds` after it was written to the state.

    A key becomes known when its batch is committed, so a batch that fails is processed again.
    """
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_FirstSeen(ttl_seconds), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime"
    )


def latest_kept(stream: DataFrame, key: str, value: str, order: str, ttl_seconds: int = V.TTL_BOOKING) -> DataFrame:
    """Changes of the latest value per key; `known` tells whether the key was still remembered.

    Which value is the latest is told by `order`, a whole number that no row lacks, and not by the order in which rows are read.
    """
    schema = T.StructType(
        [stream.schema[key], T.StructField(value, T.StringType()), T.StructField("known", T.BooleanType())]
    )
    return stream.select(key, value, order).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Latest(ttl_seconds, key, value, order), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime"
    )
