"""A keyed store on Structured Streaming: values, aliases, deletes and counters with a time to live.

Calls (ts, namespace, event_id, op, key, value, ttl) come in any order within the watermark's delay. A namespace holds
its calls until the watermark has passed them and then takes them in the order of (ts, event_id), so the
answers are those of the batch form, whatever the arrival. State is a list of waiting calls, a map of entries, a map of
aliases and the two counters; timers wake a namespace for waiting calls and for entries whose time is over, which are then removed. State
lives in RocksDB and survives a restart from the checkpoint.

Operations: ``set`` writes value for ttl seconds (null: the default; zero or less writes nothing), ``alias`` makes value another name of
key for that time, ``get`` finds a key's value or that of the key behind an alias (a key wins over an alias of its name; an alias of an alias isn't
followed), ``contains`` is a get that doesn't count, ``delete`` removes the key, and an alias of that name. Gets
count as hits or misses of the namespace. Namespaces are independent: a busy one is split by putting a
hash of the key's root into it.

Defined cases: calls without ts, namespace or key are left out; unknown operations find and change nothing; calls later than the
watermark are dropped; equal calls are taken each.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnwick.operators.state import TTL

CALL = "t long, event_id long, op string, key string, value string, ttl int"
RESULT = "namespace string, event_id long, op string, key string, found string, hits long, misses long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Store(StatefulProcessor):
    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", CALL)
        self.entries = handle.getMapState("entries", "key string", "value string, until long")
        self.aliases = handle.getMapState("aliases", "name string", "key string, until long")
        self.counters = handle.getValueState("counters", "hits long, misses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        calls = [tuple(None if pd.isna(v) else v for v in r) for frame in rows for r in frame[["t", "event_id", "op", "key", "value", "ttl"]].itertuples(index=False)]
        calls = [(int(t), int(i), op, k, v, None if ttl is None else int(ttl)) for t, i, op, k, v, ttl in calls if t // 1000 >= mark]
        if calls:
            self.waiting.appendList(calls)
            self.handle.registerTimer(min(c[0] for c in calls) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda c: c[:2]) if self.waiting.exists() else []
        due = [c for c in waiting if c[0] // 1000 < mark]
        if due:
            rest = waiting[len(due) :]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
            yield pd.DataFrame(list(self._taken(key[0], due)), columns=[c.split()[0] for c in RESULT.split(", ")])
        # no call that is still to come is before the mark, so what has ended by then is never found again
        for state in (self.entries, self.aliases):
            if state.exists():
                for name in [k for k, v in state.iterator() if v[1] // 1000 < mark]:
                    state.removeKey(name)

    def _alive(self, state, name: str, t: int):
        got = state.getValue((name,)) if state.exists() and state.containsKey((name,)) else None
        return got[0] if got is not None and t < got[1] else None

    def _find(self, name: str, t: int):
        value = self._alive(self.entries, name, t)
        target = None if value is not None else self._alive(self.aliases, name, t)
        return value if target is None else self._alive(self.entries, target, t)

    def _taken(self, namespace: str, due: list) -> Iterator[tuple]:
        hits, misses = self.counters.get() if self.counters.exists() else (0, 0)
        for t, event, op, name, value, ttl in due:
            found, life = None, self.ttl if ttl is None else ttl
            until = t + life * 1_000_000
            if op in ("get", "contains", "delete"):
                found = self._find(name, t)
            if op == "get":
                hits, misses = hits + (found is not None), misses + (found is None)
            elif op == "delete":
                for state in (self.entries, self.aliases):
                    if state.exists() and state.containsKey((name,)):
                        state.removeKey((name,))
            elif op == "set" and life > 0 and value is not None:
                self.entries.updateValue((name,), (value, until))
                self.handle.registerTimer(until // 1000 + 1)
            elif op == "alias" and life > 0 and value is not None:
                self.aliases.updateValue((value,), (name, until))
                self.handle.registerTimer(until // 1000 + 1)
            yield namespace, event, op, name, found, hits, misses
        self.counters.update((hits, misses))

    def close(self) -> None:
        pass


def answers(calls: DataFrame, ttl: int = TTL, late: str = "1 hour") -> DataFrame:
    """What each call of a stream finds, with the namespace's hits and misses up to it."""
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = calls.where("ts IS NOT NULL AND namespace IS NOT NULL AND key IS NOT NULL").withWatermark("ts", late)
    stream = stream.select("ts", "namespace", F.unix_micros("ts").alias("t"), F.col("event_id").cast("long").alias("event_id"), "op", "key", F.col("value").cast("string").alias("value"), F.col("ttl").cast("int").alias("ttl"))
    return stream.groupBy("namespace").transformWithStateInPandas(statefulProcessor=Store(ttl), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
