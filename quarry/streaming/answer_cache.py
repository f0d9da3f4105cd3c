"""The answer cache as keyed state of a request stream.

``answer_cache_stream`` answers requests as they arrive; ``ordered_cache_stream`` waits for the watermark, so that
requests that arrive out of order, and changes of the index among them, are taken in the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.cache import TTL_SECONDS

# Groups of keys that share an invalidation; each change of the index is sent to all of them.
BUCKETS = 64
DELAY = "10 minutes"

_SET_AT = T.StructType([T.StructField("set_at", T.LongType())])
_KEY = T.StructType([T.StructField("key", T.StringType())])
_WAITING = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("settable", T.BooleanType()),
        T.StructField("change", T.BooleanType()),
    ]
)
OUTPUT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("answer_set", T.BooleanType()),
    ]
)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us, UTC]" if times.dt.tz else "datetime64[us]").astype("int64")


class _AnswerCache(StatefulProcessor):
    """State is the time the key's answer was set."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.set_at = handle.getValueState("set_at", _SET_AT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        set_at = self.set_at.get()[0] if self.set_at.exists() else None
        hits, made = [], []
        for at, settable in zip(_micros(batch["ts"]), batch["settable"]):
            hit = set_at is not None and at - set_at <= self.ttl * 1_000_000
            hits.append(hit)
            made.append(bool(settable) and not hit)
            if made[-1]:
                set_at = int(at)
        if set_at is not None:
            self.set_at.update((set_at,))
        yield pd.DataFrame(
            {"key": key[0], "id": batch["id"].to_numpy(), "ts": batch["ts"].to_numpy(), "cache_hit": hits, "answer_set": made}
        )

    def close(self) -> None:
        pass


def answer_cache_stream(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Requests of a stream with ``cache_hit`` and ``answer_set``, as they arrive.

    Needs the RocksDB state store. Within a micro-batch the requests of a key
    are taken in time order; the size of a micro-batch bounds the rows a task
    holds for one key. The time of every key's last answer stays in the state; a stream
    with ever new keys belongs in ``ordered_cache_stream``, which lets them expire.
    """
    return (
        requests.selectExpr("cast(key as string) key", "cast(id as long) id", "cast(ts as timestamp) ts", "settable")
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_AnswerCache(ttl), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
        )
    )


class _OrderedCache(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; answers live in a map until they expire.

    There is a timer for the first waiting row and one for the first answer to expire.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.answers = handle.getMapState("answers", _KEY, _SET_AT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            at = _micros(batch["ts"])
            new = [
                (None if pd.isna(k) else k, None if pd.isna(i) else int(i), int(t), bool(s), bool(c))
                for k, i, t, s, c in zip(batch["key"], batch["id"], at, batch["settable"].fillna(False), batch["change"])
            ]
            if new:
                self.waiting.appendList(new)
                first = min(first or new[0][2], *[row[2] for row in new])
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Rows up to the watermark are complete: later ones of such a time are dropped as late.
        done = timerValues.getCurrentWatermarkInMs() * 1_000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in rows if r[2] <= done), key=lambda r: (r[2], not r[4], r[1] is None, r[1]))
        left = [r for r in rows if r[2] > done]
        # The answers are read once and their changes written once, however many rows are due.
        before = {own[0]: at[0] for own, at in self.answers.iterator()} if self.answers.exists() else {}
        out, now, void = [], dict(before), False
        for own, number, at, settable, change in due:
            if change:
                now, void = {}, True
                continue
            hit = own in now and at - now[own] <= self.ttl
            if settable and not hit:
                now[own] = at
            out.append((own, number, at, hit, settable and not hit))
        if due:
            if left:
                self.waiting.put(left)
                self._wake(min(r[2] for r in left))
            else:
                self.waiting.clear()
        self._keep(before, now, void, done)
        if out:
            frame = pd.DataFrame(out, columns=["key", "id", "ts", "cache_hit", "answer_set"])
            yield frame.assign(ts=pd.to_datetime(frame["ts"], unit="us"))

    def _wake(self, at: int) -> None:
        """A timer for the first millisecond that is not before the time."""
        self.handle.registerTimer(-(-at // 1_000))

    def _keep(self, before: dict, now: dict, void: bool, done: int) -> None:
        """Write the answers that changed, forget those that no later request can hit, and come back for the next one."""
        alive = {own: at for own, at in now.items() if at + self.ttl >= done}
        if before and (void or not alive):
            self.answers.clear()
            before = {}
        for own in before.keys() - alive.keys():
            self.answers.removeKey((own,))
        for own, at in alive.items():
            if before.get(own) != at:
                self.answers.updateValue((own,), (at,))
        if alive:
            # A millisecond after, so that the watermark has passed the last moment of the answer.
            self._wake(min(alive.values()) + self.ttl + 1_000)

    def close(self) -> None:
        pass


def ordered_cache_stream(
    requests: DataFrame,
    ttl: int = TTL_SECONDS,
    delay: str = DELAY,
    invalidations: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Requests of a stream with ``cache_hit`` and ``answer_set``, in the order of their times.

    A row leaves once the watermark, ``delay`` behind the latest time, has passed it; rows that arrive after
    that are dropped. State holds the rows that wait and the answers that may still be hit, so that it is as large as
    the traffic of ``delay`` and ``ttl``, whatever the number of keys.

    ``invalidations`` (a stream with ``ts``) void every answer set before them, at the same time first. Keys
    are then dealt into ``buckets`` that keep their answers together, and each invalidation is sent to every bucket. Null
    keys are a key like any other. Needs the RocksDB state store.
    """
    columns = ["cast(key as string) key", "cast(id as long) id", "cast(ts as timestamp) ts", "settable"]
    rows = requests.selectExpr(*columns, "false change")
    if invalidations is None:
        tagged = rows.withColumn("bucket", F.col("key"))
    else:
        changes = invalidations.selectExpr("cast(null as string) key", "cast(null as long) id", "cast(ts as timestamp) ts", "false settable", "true change")
        everywhere = changes.withColumn("bucket", F.explode(F.array(*[F.lit(str(b)) for b in range(buckets)])))
        own = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(buckets)).cast("string")
        tagged = rows.withColumn("bucket", own).unionByName(everywhere)
    return (
        tagged.withWatermark("ts", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_OrderedCache(ttl), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    )
