"""Replaying the answer cache over a request log.

A request hits when an answer for its key was set no longer than ``ttl`` ago
and nothing has invalidated the cache since. Hits do not extend the life of an
answer. A miss sets the answer only if its path caches (``settable``).

Requests have ``key, ts, id, settable``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import running, slice_by_order
from quarry.session import durable

# Fixed value: life of an answer in seconds.
TTL_SECONDS = 3600

# Keys with more requests than this are replayed by the distributed way.
ROWS_PER_KEY = 2000


def answer_cache_replay(
    requests: DataFrame,
    invalidations: DataFrame | None = None,
    ttl: int = TTL_SECONDS,
    rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """Requests with ``cache_hit`` and ``answer_set``.

    Keys with few requests are replayed in one pass over their sorted times.
    Keys with many are never gathered: see ``_replay_large``.
    """
    timed = requests.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_epoch", F.lit(0))
    if invalidations is not None:
        timed = _with_epoch(timed, invalidations)
    sizes = timed.groupBy("key").agg(F.count(F.lit(1)).alias("_size"))
    large = durable(sizes.filter(F.col("_size") > rows_per_key).select(F.col("key").alias("_large")))
    # A null key is a key like any other.
    same = F.col("key").eqNullSafe(F.col("_large"))
    small = _replay_small(timed.join(large, same, "left_anti"), ttl * 1_000_000)
    columns = [*requests.columns, "cache_hit", "answer_set"]
    if large.isEmpty():
        return small.select(*columns)
    rest = _replay_large(timed.join(large, same, "left_semi"), ttl * 1_000_000)
    return small.select(*columns).unionByName(rest.select(*columns))


def _with_epoch(timed: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Time of the last invalidation up to each request, 0 before the first."""
    marks = invalidations.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), F.lit(0).alias("_kind"))
    both = timed.drop("_epoch").withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    order = ["_at", "_kind", "id"]
    last = running(
        slice_by_order(both, [], order), [], order, {"_epoch": ("max", F.when(F.col("_kind") == 0, F.col("_at")))}
    )
    return last.filter("_kind = 1").withColumn("_epoch", F.coalesce("_epoch", F.lit(0))).drop("_kind")


def _replay_small(timed: DataFrame, ttl: int) -> DataFrame:
    """One fold over the sorted requests of each key, at most ROWS_PER_KEY."""
    row = F.struct("_at", "id", *[c for c in timed.columns if c not in ("_at", "id", "key", "_epoch")])
    groups = timed.groupBy("key", "_epoch").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    state = F.struct(
        F.lit(None).cast("long").alias("set_at"), F.array().cast("array<struct<hit:boolean,made:boolean>>").alias("out")
    )

    def step(acc, request):
        hit = acc["set_at"].isNotNull() & (request["_at"] - acc["set_at"] <= ttl)
        made = ~hit & request["settable"]
        return F.struct(
            F.when(made, request["_at"]).otherwise(acc["set_at"]).alias("set_at"),
            F.concat(acc["out"], F.array(F.struct(hit.alias("hit"), made.alias("made")))).alias("out"),
        )

    folded = groups.withColumn("_out", F.aggregate("_rows", state, step, lambda acc: acc["out"]))
    rows = folded.select("key", F.inline(F.arrays_zip("_rows", "_out")).alias("_row", "_result"))
    return rows.select(
        "key", "_row.*", F.col("_result.hit").alias("cache_hit"), F.col("_result.made").alias("answer_set")
    )


def _replay_large(timed: DataFrame, ttl: int) -> DataFrame:
    """Replay by pointer doubling; no key is gathered in one place.

    Every settable time points to the first one more than ``ttl`` later. The
    answers that are really set form the chain from the first time of a key;
    following pointers of length 1, 2, 4, ... reaches all of it in as many
    rounds as the chain length has binary digits.
    """
    keys = ["key", "_epoch"]
    times = durable(timed.filter("settable").select(*keys, "_at").distinct())
    jumps = durable(_next_times(times, keys, ttl))
    reached = durable(times.groupBy(*keys).agg(F.min("_at").alias("_at")))
    while True:
        ahead = durable(
            reached.join(jumps, [*keys, "_at"]).select(*keys, F.col("_next").alias("_at")).filter("_at is not null")
        )
        if ahead.isEmpty():
            break
        reached = durable(reached.unionByName(ahead).distinct())
        onward = jumps.select(*keys, F.col("_at").alias("_next"), F.col("_next").alias("_after"))
        jumps = durable(
            jumps.filter("_next is not null").join(onward, [*keys, "_next"]).select(*keys, "_at", F.col("_after").alias("_next"))
        )
    first = (
        timed.filter("settable")
        .groupBy(*keys, "_at")
        .agg(F.min("id").alias("id"))
        .join(reached, [*keys, "_at"], "left_semi")
        .withColumn("answer_set", F.lit(True))
    )
    order = ["_at", "id"]
    marked = timed.join(first, [*keys, *order], "left").withColumn("answer_set", F.coalesce("answer_set", F.lit(False)))
    last = running(
        slice_by_order(marked, keys, order), keys, order, {"_set_at": ("max", F.when(F.col("answer_set"), F.col("_at")))}
    )
    alive = F.col("_set_at").isNotNull() & (F.col("_at") - F.col("_set_at") <= ttl)
    return last.withColumn("cache_hit", ~F.col("answer_set") & alive)


def _next_times(times: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """``_next``: the first time of the key later than ``_at + ttl``.

    Times and probes are scanned together from the latest backwards; the
    running maximum of the negated times is then the nearest one ahead.
    """
    order = ["_back", "_kind", "_at"]
    both = times.select(*keys, "_at", (-F.col("_at")).alias("_back"), F.lit(1).alias("_kind")).unionByName(
        times.select(*keys, "_at", (-F.col("_at") - ttl).alias("_back"), F.lit(0).alias("_kind"))
    )
    nearest = running(
        slice_by_order(both, keys, order), keys, order, {"_near": ("max", F.when(F.col("_kind") == 1, F.col("_back")))}
    )
    return nearest.filter("_kind = 0").select(*keys, "_at", (-F.col("_near")).alias("_next"))
