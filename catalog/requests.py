"""Request metrics and the answer cache over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import requests_v, scratch, sql, table
from catalog.registry import Registry
from quarry.operators import cache, metrics
from quarry.streaming.answer_cache import answer_cache_stream, ordered_cache_stream

registry = Registry()
QUERIES, SQL, entry = registry.queries, registry.sql, registry.entry


@entry("requests_by_path", sql("SELECT path, count(*) AS requests FROM requests_v GROUP BY path", "requests_v"))
def requests_by_path(spark, folder):
    return metrics.requests_by_path(requests_v(spark, folder))


_LE = ", ".join(str(float(b)) for b in metrics.LATENCY_BOUNDS)
_BUCKETS = f"""SELECT path, le, count(*) FILTER (WHERE latency_seconds <= le) AS cumulative
    FROM requests_v, (SELECT unnest([{_LE}, CAST('Infinity' AS DOUBLE)]) AS le) GROUP BY path, le"""


@entry("latency_histogram", sql(_BUCKETS, "requests_v"))
def latency_histogram(spark, folder):
    return metrics.latency_histogram(requests_v(spark, folder))


_SOURCE_LE = ", ".join(str(b) for b in metrics.SOURCES_BOUNDS)


@entry(
    "sources_histogram",
    sql(
        f"""SELECT le, count(*) FILTER (WHERE sources <= le) AS cumulative, sum(sources) AS total_sum, count(sources) AS total_count
        FROM requests_v, (SELECT unnest([{_SOURCE_LE}, CAST('Infinity' AS DOUBLE)]) AS le)
        WHERE path IN ('rag', 'no_info') GROUP BY le""",
        "requests_v",
    ),
)
def sources_histogram(spark, folder):
    return metrics.sources_histogram(requests_v(spark, folder))


def _quantile_sql(buckets: str, by: str, name: str) -> str:
    """Interpolated 95 % quantile of cumulative buckets, grouped by ``by``."""
    return f"""SELECT {by}, round(arg_min(CASE WHEN isinf(le) THEN below_le
            ELSE below_le + (le - below_le) * CASE WHEN cumulative > below THEN (rank - below) / (cumulative - below) ELSE 1 END END, le), 6) AS {name}
        FROM (SELECT *, 0.95 * max(cumulative) OVER (PARTITION BY {by}) AS rank,
                coalesce(lag(cumulative) OVER (PARTITION BY {by} ORDER BY le), 0) AS below,
                coalesce(lag(le) OVER (PARTITION BY {by} ORDER BY le), 0) AS below_le FROM ({buckets}))
        WHERE cumulative >= rank GROUP BY {by}"""


@entry("histogram_quantile", sql(_quantile_sql(_BUCKETS, "path", "quantile"), "requests_v"))
def histogram_quantile(spark, folder):
    return metrics.histogram_quantile(requests_v(spark, folder)).withColumn("quantile", F.round("quantile", 6))


# Each request falls into five sliding windows.
WINDOWED = """SELECT *, time_bucket(INTERVAL 1 minute, ts) - to_minutes(i) AS window_start,
    time_bucket(INTERVAL 1 minute, ts) - to_minutes(i) + INTERVAL 5 minutes AS window_end
    FROM requests_v, (SELECT unnest(range(0, 5)) AS i)"""


@entry(
    "request_rate_5m",
    sql(
        """SELECT window_start, window_end, path, round(count(*) / 300.0, 6) AS per_second FROM windowed
        GROUP BY window_start, window_end, path""",
        "requests_v",
        windowed=WINDOWED,
    ),
)
def request_rate_5m(spark, folder):
    return metrics.request_rate_5m(requests_v(spark, folder)).withColumn("per_second", F.round("per_second", 6))


_WINDOW_BUCKETS = f"""SELECT window_start, window_end, path, le, count(*) FILTER (WHERE latency_seconds <= le) AS cumulative
    FROM windowed, (SELECT unnest([{_LE}, CAST('Infinity' AS DOUBLE)]) AS le) GROUP BY ALL"""


@entry(
    "latency_p95_5m",
    sql(_quantile_sql(_WINDOW_BUCKETS, "window_start, window_end, path", "p95"), "requests_v", windowed=WINDOWED),
)
def latency_p95_5m(spark, folder):
    return metrics.latency_p95_5m(requests_v(spark, folder)).withColumn("p95", F.round("p95", 6))


@entry(
    "share_5m",
    sql(
        """SELECT window_start, window_end, round(count(*) FILTER (WHERE path = 'cache') / count(*), 6) AS cache_share,
            round(count(*) FILTER (WHERE path = 'smalltalk') / count(*), 6) AS smalltalk_share,
            round(count(*) FILTER (WHERE path IN ('no_info', 'threshold_refused')) / count(*), 6) AS refusal_share
        FROM windowed GROUP BY window_start, window_end""",
        "requests_v",
        windowed=WINDOWED,
    ),
)
def share_5m(spark, folder):
    shares = metrics.share_5m(requests_v(spark, folder))
    return shares.withColumns({c: F.round(c, 6) for c in shares.columns if c.endswith("share")})


@entry(
    "avg_sources_5m",
    sql(
        """SELECT window_start, window_end, round(avg(sources), 6) AS avg_sources FROM windowed
        WHERE path IN ('rag', 'no_info') GROUP BY window_start, window_end""",
        "requests_v",
        windowed=WINDOWED,
    ),
)
def avg_sources_5m(spark, folder):
    return metrics.avg_sources_5m(requests_v(spark, folder)).withColumn("avg_sources", F.round("avg_sources", 6))


# What reaches the cache: everything but small talk; answers of two paths are kept.
def cache_requests(spark, folder):
    log = requests_v(spark, folder).filter("path <> 'smalltalk'")
    return log.selectExpr("user_id key", "ts", "event_id id", "path in ('rag', 'no_info') settable")


REACHING = """SELECT user_id AS key, ts, event_id AS id, path IN ('rag', 'no_info') AS settable,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM requests_v WHERE path <> 'smalltalk'"""


def _replay_sql(alive: str) -> str:
    return f"""SELECT key, ts, id, settable, hit AS cache_hit, settable AND NOT hit AS answer_set FROM (
        WITH RECURSIVE replay AS (
            SELECT r.*, false AS hit, CASE WHEN settable THEN ts END AS set_at FROM reaching r WHERE n = 1
            UNION ALL
            SELECT r.key, r.ts, r.id, r.settable, r.n, coalesce({alive}, false),
                CASE WHEN r.settable AND NOT coalesce({alive}, false) THEN r.ts ELSE p.set_at END
            FROM replay p JOIN reaching r ON r.key = p.key AND r.n = p.n + 1)
        SELECT * FROM replay)"""


@entry(
    "answer_cache_replay",
    sql(_replay_sql("r.ts - p.set_at <= INTERVAL 1 hour"), "requests_v", reaching=REACHING),
)
def answer_cache_replay(spark, folder):
    return cache.answer_cache_replay(cache_requests(spark, folder))


# A day's life, so that answers live on, and an index change every few hours.
CHANGES = "SELECT DISTINCT time_bucket(INTERVAL 6 hours, ts) AS ts FROM events"


@entry(
    "answer_cache_invalidated",
    sql(
        _replay_sql(
            "r.ts - p.set_at <= INTERVAL 1 day AND NOT EXISTS (SELECT 1 FROM changes c WHERE c.ts > p.set_at AND c.ts <= r.ts)"
        ),
        "requests_v",
        reaching=REACHING,
        changes=CHANGES,
    ),
)
def answer_cache_invalidated(spark, folder):
    changes = table(spark, folder, "events").select(F.window("ts", "6 hours")["start"].alias("ts")).distinct()
    return cache.answer_cache_replay(cache_requests(spark, folder), changes, 86_400)


@entry(
    "answer_cache_replay_large",
    sql(_replay_sql("r.ts - p.set_at <= INTERVAL 1 day"), "requests_v", reaching=REACHING),
)
def answer_cache_replay_large(spark, folder):
    """Every key by the way meant for very frequent ones."""
    return cache.answer_cache_replay(cache_requests(spark, folder), ttl=86_400, rows_per_key=0)


@entry(
    "answer_cache_stream",
    sql(_replay_sql("r.ts - p.set_at <= INTERVAL 1 hour").replace("SELECT key, ts, id, settable, hit", "SELECT CAST(key AS VARCHAR) AS key, id, hit"), "requests_v", reaching=REACHING),
)
def answer_cache_stream_query(spark, folder):
    """The log as a stream against keyed state."""
    root = scratch(spark)
    cache_requests(spark, folder).repartition(1).sortWithinPartitions("ts", "id").write.parquet(f"{root}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/log").schema).parquet(f"{root}/log")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    query = (
        answer_cache_stream(stream)
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("key", "id", "cache_hit", "answer_set")


def _ordered(spark, folder, ttl, changes=None):
    """The log dealt over micro-batches by hash, then two requests long after that move the watermark."""
    root = scratch(spark)
    log = cache_requests(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    later = log.agg(F.max("ts").alias("ts")).selectExpr("cast(null as long) key", "ts", "-1L id", "false settable")
    for part in range(3):
        log.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part).coalesce(1).write.parquet(f"{root}/log/{part}")
    for days in (100, 200):
        later.withColumn("ts", F.col("ts") + F.make_interval(days=F.lit(days))).write.parquet(f"{root}/log/later-{days}")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )

    def read(path, schema):
        return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)

    if changes is not None:
        changes.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{root}/changes")
    marks = None if changes is None else read(f"{root}/changes", "ts timestamp")
    query = (
        ordered_cache_stream(read(f"{root}/log", log.schema), ttl, "60 days", marks, buckets=8)
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").where("id >= 0").select("key", "id", "cache_hit", "answer_set")


def _stream_sql(alive):
    return _replay_sql(alive).replace("SELECT key, ts, id, settable, hit", "SELECT CAST(key AS VARCHAR) AS key, id, hit")


@entry("answer_cache_ordered", sql(_stream_sql("r.ts - p.set_at <= INTERVAL 1 hour"), "requests_v", reaching=REACHING))
def answer_cache_ordered(spark, folder):
    """Requests out of order over micro-batches, taken in the order of their times."""
    return _ordered(spark, folder, 3600)


@entry(
    "answer_cache_ordered_invalidated",
    sql(
        _stream_sql("r.ts - p.set_at <= INTERVAL 1 day AND NOT EXISTS (SELECT 1 FROM changes c WHERE c.ts > p.set_at AND c.ts <= r.ts)"),
        "requests_v",
        reaching=REACHING,
        changes=CHANGES,
    ),
)
def answer_cache_ordered_invalidated(spark, folder):
    """Requests and changes of the index as two streams into one state."""
    changes = table(spark, folder, "events").select(F.window("ts", "6 hours")["start"].alias("ts")).distinct()
    return _ordered(spark, folder, 86_400, changes)
