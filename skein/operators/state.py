"""Rules, state and time over events: telemetry adjudication, energy and heat, caches and expiry, ledgers, snapshots, control.

Most are one SQL text for Spark; {table} names a table of the folder. Sequential folds, whose clamps depend on order, stream through
sorted partitions with one state a key."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: Anchors of the telemetry filter, in the order of its ten rules (fixed values).
ANCHORS = {"p50_ms": 8.0, "p99_ms": 12.0, "r1": 0.85, "r5": 0.95, "cpu_temp": 75.0, "memory_pct": 90.0, "autopoiesis": 0.5}


_NUMBER = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def _spark(text: str) -> str:
    return _NUMBER.sub(r"\1D", re.sub(r"EPOCH\((\w+)\)", r"unix_timestamp(\1)", text))


def _duck(text: str) -> str:
    text = re.sub(r"\{(\w+)\}", r"\1", re.sub(r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text))
    return _NUMBER.sub(r"\1::DOUBLE", text)


def same(text: str) -> tuple[Callable, str]:
    """A query that both engines run from one text: EPOCH(x) is x in whole seconds, numbers with a point are doubles."""
    text = " ".join(text.split())

    def run(spark, sf_dir) -> DataFrame:
        return spark.sql(_spark(text), **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})

    return run, _duck(text)


#: Users of a part of a bucket: two parts make a million pairs at most.
USERS = 1_024
U = "PARTITION BY user_id ORDER BY ts, event_id"
#: Telemetry of each quarter of a day, from its events.
TEL = """t AS (SELECT CAST(floor(EPOCH(ts) / 21600) AS BIGINT) AS tick, round(avg(value) / 5, 6) AS p50_ms, round(max(value) / 9, 6) AS p99_ms,
 round(1 - avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS r1, round(1 - avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) / 3, 6) AS r5,
 round(40 + 150 * avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS cpu_temp, round(count(DISTINCT user_id) * 1.0, 6) AS memory_pct,
 round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) * 2, 6) AS autopoiesis,
 max(CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END) AS exam, CAST(sum(CASE WHEN event_id % 499 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS git, CAST(sum(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) AS BIGINT) AS trips
 FROM {events} GROUP BY CAST(floor(EPOCH(ts) / 21600) AS BIGINT))"""
_CLAMP = "greatest(0.0, least(1.0, {}))"
DIVERGENCE = f"""0.5 * (p50_ms / 8 + p99_ms / 12) * 0.5 + 0.15 * ((1 - {_CLAMP.format('r1')}) / 0.15 + (1 - {_CLAMP.format('r5')}) / 0.05) * 0.5
 + 0.1 * cpu_temp / 75 + 0.05 * memory_pct / 90 + 0.05 * (1 - {_CLAMP.format('autopoiesis')}) + 0.05 * trips"""
_RULES = [f"p50_ms > {ANCHORS['p50_ms']}", f"p99_ms > {ANCHORS['p99_ms']}", f"r1 < {ANCHORS['r1']}", f"r5 < {ANCHORS['r5']}", f"cpu_temp > {ANCHORS['cpu_temp']}", f"memory_pct > {ANCHORS['memory_pct']}", f"autopoiesis < {ANCHORS['autopoiesis']}", "exam > 0", "git > 0", "trips > 0"]
_GOALS = ["p50_ms < 8", "p99_ms < 12", "r1 > 0.85", "r5 > 0.95", "cpu_temp < 65", "memory_pct < 80", "autopoiesis > 0.8", "trips = 0"]  # fixed values


def _word(rules: list[str]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {r} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules)) + " AS BIGINT)"


_HARD = f"CASE WHEN {_CLAMP.format('p50_ms / 20')} >= {_CLAMP.format('cpu_temp / 100')} AND {_CLAMP.format('p50_ms / 20')} >= {_CLAMP.format('memory_pct / 100')} THEN 'G0' WHEN {_CLAMP.format('cpu_temp / 100')} >= {_CLAMP.format('memory_pct / 100')} THEN 'G8' ELSE 'G6' END"
_L, _R, _T = _CLAMP.format("p50_ms / 8"), _CLAMP.format("(1 - r1) / 0.15"), _CLAMP.format("(cpu_temp - 60) / 15")
_SOFT = f"CASE WHEN {_L} >= {_R} AND {_L} >= {_T} THEN 'G0' WHEN {_R} >= {_T} THEN 'G7' WHEN {_T} > 0 THEN 'G8' ELSE 'G0' END"
_META = "exam > 0 OR git > 0 OR cpu_temp > 75 OR memory_pct > 90"


def ordered_fold(df: DataFrame, key: str, order: list[str], value: str, start, step: Callable, out: str) -> DataFrame:
    """df with column `out`: the state of row's key after step(state, value) of its rows in order. Rows stream through sorted partitions, so a key of very many rows is never held."""
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            got = []
            for k, v in zip(b.column(kept.index(key)).to_pylist(), b.column(kept.index(value)).to_pylist(), strict=True):
                if k != now:
                    now, state = k, start
                state = state if v is None else step(state, v)
                got.append(state)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string() if isinstance(start, str) else pa.float64())], [*kept, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` " + ("string" if isinstance(start, str) else "double")
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def trust_scores(spark, sf_dir):
    """Each user's trust, from a half: a tenth up for every event but errors, which take a tenth, within 0 and 1."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", -0.1).otherwise(0.1).alias("change"))
    return ordered_fold(e, "user_id", ["ts", "event_id"], "change", 0.5, lambda s, d: round(max(0.0, min(1.0, s + d)), 6), "trust").select("event_id", "trust")


def scar_bias(spark, sf_dir):
    """Each user's bias, from 1: an error adds 0.15, and 0.1 more if there was one before with at most 1000 quiet rows since; a quiet row takes a thousandth. Within 1 and 2."""
    w = _by("user_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).withColumn("error", F.col("event_type") == "error")
    last = F.max(F.when(F.col("error"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    change = F.when(~F.col("error"), 0.0).when(F.col("n") - last <= 1001, 0.25).otherwise(0.15)
    e = e.select("event_id", "user_id", "ts", change.alias("change"))
    return ordered_fold(e, "user_id", ["ts", "event_id"], "change", 1.0, lambda s, d: round(min(2.0, s + d) if d else max(1.0, s * 0.999), 6), "bias").select("event_id", "bias")


def ledger_chain(spark, sf_dir):
    """Each user's hash chain: SHA-256 of the entry before and of the event's id and type; the first stands on `genesis`."""
    import hashlib

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.concat_ws("|", "event_id", "event_type").alias("entry"))
    return ordered_fold(e, "user_id", ["ts", "event_id"], "entry", "genesis", lambda s, x: hashlib.sha256(f"{s}|{x}".encode()).hexdigest(), "digest").select("event_id", "digest")


def ledger_verify(spark, sf_dir):
    """How many entries of each user stand on the entry before them."""
    c = ledger_chain(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "event_id")
    good = F.col("digest") == F.sha2(F.concat_ws("|", F.coalesce(F.lag("digest").over(_by("user_id")), F.lit("genesis")), "event_id", "event_type"), 256)
    return c.select("user_id", good.cast("long").alias("good")).groupBy("user_id").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))


def _by(key: str):
    return Window.partitionBy(key).orderBy("ts", "event_id")


def _list(what: str) -> str:
    return f"list({what} ORDER BY ts, event_id)"


_FOLD = "g AS (SELECT user_id, {lists}, list(event_id ORDER BY ts, event_id) AS ids FROM e GROUP BY 1), x AS (SELECT user_id, unnest(ids) AS event_id, ds, unnest(range(len(ids))) AS i FROM g)"
#: Energy of cells: users' events put value / 100 into the cell user_id % 16, which decays by 0.99 an hour.
HEAT = """h AS (SELECT user_id % 16 AS cell, value / 100 AS amount, CAST(floor(EPOCH(ts) / 3600) AS BIGINT) AS hour FROM {events})"""
SPILL = """s AS (SELECT cell, amount, hour FROM h UNION ALL SELECT cell - 1, 0.3 * amount, hour FROM h WHERE cell > 0 UNION ALL SELECT cell + 1, 0.3 * amount, hour FROM h)"""
CUT = "TIMESTAMP '2024-01-15 00:00:00'"
def same_bucket_pairs(spark, sf_dir) -> DataFrame:
    """Every two users of a bucket that have signed up. Buckets are a fixed few, so each is dealt to parts of users, and every two parts meet in a group of their own."""
    b = table(spark, sf_dir, "events").where("event_type = 'signup' and user_id is not null").select((F.col("user_id") % 25).cast("long").alias("bucket"), F.col("user_id").cast("long").alias("user_id")).distinct()
    n = b.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0  # of 25 buckets, and as many below 0
    parts = max(1, -(-n // USERS))
    b = b.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int"))
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    low, high = b.withColumn("other", all_parts).withColumnRenamed("user_id", "low"), b.withColumnRenamed("part", "other").withColumn("part", all_parts).withColumnRenamed("user_id", "high")
    return low.join(high.hint("merge"), ["bucket", "part", "other"]).where("low < high").select("bucket", "low", "high")


QUERIES = {
    "telemetry_flags": same(f"WITH {TEL} SELECT tick, {_word(_RULES)} AS flags FROM t"),
    "telemetry_adjudication": same(f"WITH {TEL}, d AS (SELECT *, round({DIVERGENCE}, 4) AS divergence FROM t) SELECT tick, divergence, CASE WHEN {_META} THEN 'severe' WHEN divergence > 1.5 THEN 'hard' WHEN divergence > 0.5 THEN 'soft' ELSE 'none' END AS level, CASE WHEN exam > 0 THEN 'G5' WHEN git > 0 THEN 'G9' WHEN cpu_temp > 75 THEN 'G8' WHEN memory_pct > 90 THEN 'G6' WHEN divergence > 1.5 THEN {_HARD} WHEN divergence > 0.5 THEN {_SOFT} ELSE 'none' END AS gear FROM d"),
    "goal_bitmask": same(f"WITH {TEL} SELECT tick, {_word(_GOALS)} AS goals FROM t"),
    "self_tuning": same(f"WITH {TEL}, l AS (SELECT tick, p50_ms, lag(p50_ms) OVER (ORDER BY tick) AS before, r1, lag(r1) OVER (ORDER BY tick) AS r1_before FROM t) SELECT tick, round(100 * (p50_ms - before) / before, 4) AS change_pct, CASE WHEN r1 < r1_before THEN 25 WHEN p50_ms > before THEN -25 ELSE 0 END AS ef_step FROM l WHERE before IS NOT NULL"),
    "lagged_correlation": same(f"WITH {TEL}, l AS (SELECT p50_ms AS a, lag(p50_ms) OVER (ORDER BY tick) AS b, r1 AS c, lag(r1) OVER (ORDER BY tick) AS d FROM t) SELECT round(corr(a, b), 6) AS p50_p50, round(corr(a, d), 6) AS p50_r1, round(corr(c, b), 6) AS r1_p50, round(corr(c, d), 6) AS r1_r1 FROM l WHERE b IS NOT NULL"),
    "equilibrium_score": same(f"WITH {TEL} SELECT tick, round(0.4 * r1 + 0.2 * r5 + 0.2 * (1 - least(1.0, cpu_temp / 100)) + 0.1 * (1 - least(1.0, memory_pct / 100)) + 0.1 * least(1.0, autopoiesis), 6) AS score FROM t"),
    "circuit_breaker": same(f"WITH e AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({U} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS failures FROM {{events}}) SELECT event_id, CAST(failures AS BIGINT) AS failures, failures >= 3 AS is_open FROM e"),
    "health_bands": same(f"WITH e AS (SELECT event_id, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) OVER ({U} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS accuracy FROM {{events}}) SELECT event_id, accuracy, CASE WHEN accuracy >= 0.85 THEN 'green' WHEN accuracy >= 0.6 THEN 'yellow' ELSE 'red' END AS band FROM e"),
    "pinned_paths": same(f"WITH e AS (SELECT event_id, count(*) OVER ({U} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS n, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) OVER ({U} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), 6) AS long_run, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) OVER ({U} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS short_run FROM {{events}}) SELECT event_id, n >= 40 AND long_run >= 0.9 AND short_run >= 0.9 AS pinned FROM e"),
    "ema_velocity": same(f"WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM {{events}}) SELECT user_id, round(sum(0.1 * value * pow(0.9, age)), 5) AS velocity FROM e GROUP BY user_id"),
    "wallet_balance": same(f"WITH e AS (SELECT event_id, 100 + sum(CASE WHEN event_type = 'error' THEN -10 WHEN event_type = 'purchase' THEN 3 ELSE 1 END) OVER ({U} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM {{events}}) SELECT event_id, CAST(balance AS BIGINT) AS balance, balance <= 0 AS bankrupt FROM e"),
    "heat_spill": same(f"WITH {HEAT}, {SPILL} SELECT CAST(cell AS BIGINT) AS cell, round(sum(amount), 5) AS heat FROM s GROUP BY cell"),
    "heat_decay": same(f"WITH {HEAT}, {SPILL}, n AS (SELECT max(hour) AS now FROM h), d AS (SELECT cell, round(sum(amount * pow(0.95, now - hour)), 6) AS heat FROM s, n GROUP BY cell) SELECT CAST(cell AS BIGINT) AS cell, heat FROM d WHERE heat >= 0.001"),
    "top_hot": same(f"WITH {HEAT}, {SPILL}, t AS (SELECT cell, round(sum(amount), 5) AS heat FROM s GROUP BY cell), r AS (SELECT CAST(cell AS BIGINT) AS cell, heat, row_number() OVER (ORDER BY heat DESC, cell) AS rank FROM t) SELECT * FROM r WHERE rank <= 5"),
    "gravity_decay": same("WITH c AS (SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY user_id), d AS (SELECT user_id, CAST(floor(n * 0.5) AS BIGINT) AS n FROM c) SELECT user_id, n FROM d WHERE n > 0"),
    "cell_energy": same(f"WITH {HEAT}, n AS (SELECT max(hour) AS now FROM h), e AS (SELECT cell, count(*) AS n, max(hour) AS last_hour, round(sum(amount * pow(0.99, now - hour)), 5) AS energy FROM h, n GROUP BY cell) SELECT CAST(cell AS BIGINT) AS cell, n, last_hour, energy, energy >= 20 AS hot FROM e"),
    "historical_energy": same(f"WITH {HEAT}, k AS (SELECT max(hour) - 24 AS now FROM h), e AS (SELECT cell, round(sum(amount * pow(0.99, now - hour)), 5) AS energy FROM h CROSS JOIN k WHERE hour <= now GROUP BY cell), m AS (SELECT round(avg(energy), 5) AS target FROM e), r AS (SELECT CAST(cell AS BIGINT) AS cell, energy, row_number() OVER (ORDER BY abs(energy - target), cell) AS rank FROM e CROSS JOIN m WHERE abs(energy - target) <= 20) SELECT * FROM r WHERE rank <= 5"),
    "rebucketing": same(f"WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {{events}}) SELECT user_id, event_type AS bucket FROM e WHERE r = 1"),
    "snapshot_delta": same(f"WITH o AS (SELECT user_id % 50 AS bucket, count(*) AS n FROM {{events}} WHERE ts <= {CUT} AND event_type = 'view' GROUP BY user_id % 50), w AS (SELECT user_id % 50 AS bucket, count(*) AS n FROM {{events}} WHERE ts > {CUT} AND event_type = 'click' GROUP BY user_id % 50), d AS (SELECT coalesce(o.bucket, w.bucket) AS bucket, coalesce(o.n, 0) AS old_count, coalesce(w.n, 0) AS new_count FROM o FULL OUTER JOIN w ON o.bucket = w.bucket) SELECT CAST(bucket AS BIGINT) AS bucket, old_count, new_count, new_count - old_count AS delta, CASE WHEN new_count - old_count > 5 THEN 'growing' WHEN new_count - old_count < -5 THEN 'shrinking' ELSE 'stable' END AS trend FROM d WHERE old_count <> new_count"),
    "delta_log": same("WITH e AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS tick FROM {events} WHERE event_type = 'signup') SELECT event_id, CAST(tick AS BIGINT) AS tick, round(sum(value) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS total, tick % 24 = 0 AS snapshot FROM e"),
    "snapshot_ring": same(f"WITH s AS (SELECT CAST(floor(EPOCH(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM {{events}} GROUP BY CAST(floor(EPOCH(ts) / 86400) AS BIGINT)), r AS (SELECT day, n, row_number() OVER (ORDER BY day DESC) AS age FROM s WHERE day <= 19737) SELECT day, n, age FROM r WHERE age <= 24"),
    "ttl_lookup": same(f"WITH e AS (SELECT event_id, EPOCH(ts) - EPOCH(before) AS age FROM (SELECT event_id, ts, lag(ts) OVER ({U}) AS before FROM {{events}}) q) SELECT event_id, CASE WHEN age IS NULL THEN 'miss' WHEN age > 86400 THEN 'expired' ELSE 'hit' END AS outcome FROM e"),
    "hit_statistics": same(f"WITH e AS (SELECT event_type, value, CASE WHEN EPOCH(ts) - EPOCH(before) <= 86400 THEN 1 ELSE 0 END AS hit FROM (SELECT event_type, value, ts, lag(ts) OVER ({U}) AS before FROM {{events}}) q) SELECT event_type, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(1 - hit) AS BIGINT) AS misses, round(avg(CASE WHEN hit = 1 THEN value END), 6) AS mean_hit FROM e GROUP BY event_type"),
    "feed_health": same("WITH e AS (SELECT event_type, max(EPOCH(ts)) AS last_seen FROM {events} GROUP BY event_type), n AS (SELECT max(last_seen) AS now FROM e) SELECT event_type, now - last_seen AS silent, now - last_seen <= 600 AS healthy FROM e, n"),
    "feed_ring": same("WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age, count(*) OVER (PARTITION BY event_type) AS n FROM {events}) SELECT event_type, event_id, CAST(greatest(n - 256, 0) AS BIGINT) AS dropped FROM e WHERE age <= 256"),
    "batch_fusion": same("WITH b AS (SELECT CAST(floor(EPOCH(ts) / 300) AS BIGINT) AS batch, user_id % 8 AS prefix, count(*) AS n FROM {events} GROUP BY CAST(floor(EPOCH(ts) / 300) AS BIGINT), user_id % 8) SELECT CAST(sum(n) AS BIGINT) AS queries, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 1.0 / sum(n), 6) AS fusion_rate FROM b"),
    "appointments": same("WITH a AS (SELECT event_id, user_id, EPOCH(ts) + 3600 * (event_id % 48) AS due FROM {events} WHERE event_type = 'signup'), n AS (SELECT max(EPOCH(ts)) - 86400 AS now FROM {events}) SELECT event_id, due, CASE WHEN due < now - 86400 THEN 'overdue' WHEN due <= now THEN 'due' ELSE 'pending' END AS state FROM a, n"),
    "co_occurrence_top": same("WITH s AS (SELECT DISTINCT user_id, event_type, CAST(floor(EPOCH(ts) / 86400) AS BIGINT) AS day FROM {events}), p AS (SELECT a.event_type AS kind, b.event_type AS other, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type <> b.event_type GROUP BY a.event_type, b.event_type), r AS (SELECT kind, other, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, other) AS rank FROM p) SELECT kind, other, n FROM r WHERE rank = 1"),
    "pattern_chains": same("WITH p AS (SELECT user_id % 8 AS pattern, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS accuracy, count(*) AS seen FROM {events} GROUP BY user_id % 8) SELECT CAST(pattern AS BIGINT) AS pattern, seen, round(accuracy, 6) AS accuracy, CASE WHEN accuracy >= 0.95 THEN 'hash' WHEN accuracy >= 0.85 THEN 'hash+spectral' ELSE 'full' END AS chain FROM p"),
    "uncertain_stages": same("SELECT event_id, value < 1000 AND (value >= 60 OR value BETWEEN 40 AND 60) AS run_spectral, CASE WHEN value >= 95 THEN 'skip_all' WHEN value >= 85 THEN 'skip_last' WHEN value BETWEEN 40 AND 60 THEN 'run_anyway' WHEN value > 60 THEN 'run' ELSE 'stop' END AS decision FROM {events}"),
    "intent_rules": same("WITH b AS (SELECT user_id, count(*) AS size, round(least(avg(value) / 60, 1.0), 6) AS confidence FROM {events} GROUP BY user_id) SELECT user_id, CASE WHEN confidence >= 0.98 AND size = 1 THEN 'exact' WHEN confidence >= 0.85 AND size < 5 THEN 'semantic' ELSE 'exploration' END AS intent FROM b"),
    "gate_cascade": same("SELECT event_id, CASE WHEN value < 1 THEN 'reject' WHEN value > 190 THEN 'accept' WHEN event_type = 'error' THEN 'reject' WHEN event_type = 'purchase' AND value > 20 THEN 'accept' ELSE 'pass' END AS gate FROM {events}"),
    "dispute_rule": same("WITH m AS (SELECT event_type, avg(value) AS mean FROM {events} GROUP BY event_type) SELECT event_id, e.event_type = 'error' AND value > 50 OR value > 3 * mean AS disputed FROM {events} e JOIN m ON e.event_type = m.event_type"),
    "safety_limits": same("SELECT event_id, event_type IN ('view', 'click', 'purchase') AND value <= 150 AND value >= 0 AS allowed FROM {events}"),
    "conjecture_rules": same("WITH r AS (SELECT event_type, user_id % 4 AS arm, count(*) AS n, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS accuracy FROM {events} GROUP BY event_type, user_id % 4), b AS (SELECT event_type, arm, n, round(accuracy, 6) AS accuracy, row_number() OVER (PARTITION BY event_type ORDER BY round(accuracy, 6) DESC, arm) AS rank FROM r) SELECT event_type, CAST(arm AS BIGINT) AS arm, accuracy, accuracy >= 0.65 AS valid FROM b WHERE rank = 1"),
    "hindsight_labels": same("SELECT event_id, user_id, 2 AS weight FROM {events} WHERE event_type = 'error' AND value > 20"),
    "veto_quantiles": same("WITH q AS (SELECT user_id, event_id, value, percent_rank() OVER (PARTITION BY user_id ORDER BY value) AS p FROM {events}) SELECT user_id, CAST(sum(CASE WHEN p >= 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS q25, CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS q50, CAST(sum(CASE WHEN p >= 0.75 THEN 1 ELSE 0 END) AS BIGINT) AS q75 FROM q GROUP BY user_id"),
    "ranking_functions": same("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS r, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS d, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS BIGINT) AS quarter FROM {events}"),
    "range_frames": same("WITH e AS (SELECT event_id, user_id, EPOCH(ts) AS s, value FROM {events}) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 4) AS total FROM e"),
    "interval_join": same("WITH p AS (SELECT user_id, event_id, EPOCH(ts) AS s FROM {events} WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id, EPOCH(ts) AS s FROM {events} WHERE event_type = 'view') SELECT p.event_id, count(v.event_id) AS views FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.s BETWEEN p.s - 172800 AND p.s GROUP BY p.event_id"),
    "same_bucket_pairs": (same_bucket_pairs, same("WITH b AS (SELECT DISTINCT user_id % 25 AS bucket, user_id FROM {events} WHERE event_type = 'signup') SELECT CAST(a.bucket AS BIGINT) AS bucket, a.user_id AS low, b.user_id AS high FROM b a JOIN b ON a.bucket = b.bucket AND a.user_id < b.user_id")[1]),
    "link_table": same("WITH c AS (SELECT DISTINCT user_id, event_type FROM {events}), n AS (SELECT event_type, count(*) AS users FROM c GROUP BY event_type) SELECT c.user_id, count(*) AS kinds, CAST(sum(users) AS BIGINT) AS reach FROM c JOIN n ON c.event_type = n.event_type GROUP BY c.user_id"),
    "upsert": same(f"WITH n AS (SELECT c_custkey AS k, c_acctbal + 1 AS bal FROM {{customer}} WHERE c_custkey % 3 = 0 UNION ALL SELECT max(c_custkey) + 1, 0.0 FROM {{customer}}) SELECT coalesce(n.k, c.c_custkey) AS k, round(coalesce(n.bal, c.c_acctbal), 2) AS bal, c.c_name IS NULL AS inserted FROM {{customer}} c FULL OUTER JOIN n ON n.k = c.c_custkey"),
    "update_by_key": same("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"),
    "range_batches": same("SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM {orders} WHERE o_orderkey >= 1000 AND o_orderkey < 9000 GROUP BY CAST(floor(o_orderkey / 1000) AS BIGINT)"),
    "modulo_scan": same("SELECT o_orderkey FROM {orders} WHERE o_orderkey % 64 = 7"),
    "null_predicates": same("SELECT doc_id FROM {documents} WHERE text IS NOT NULL AND length(trim(text)) > 3"),
    "recent_rows": same(f"SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN value END), 6) AS high FROM {{events}} WHERE ts > TIMESTAMP '2024-01-29 00:00:00' - INTERVAL '24' HOUR AND ts <= TIMESTAMP '2024-01-29 00:00:00' GROUP BY event_type"),
    "epoch_minutes": same("SELECT event_id, CAST(floor(EPOCH(ts) / 60) AS BIGINT) AS minute, CAST(floor(EPOCH(ts) / 432000) AS BIGINT) AS five_days FROM {events}"),
    "union_sets": same("SELECT user_id FROM {events} WHERE event_type = 'signup' UNION SELECT user_id FROM {events} WHERE event_type = 'error'"),
    "difference_sets": same("SELECT user_id FROM {events} WHERE event_type = 'view' AND value > 10 EXCEPT SELECT user_id FROM {events} WHERE event_type = 'error' AND value > 50"),
    "backfill_union": same("WITH a AS (SELECT user_id, event_id, 0 AS tier, value FROM {events} WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 1, value FROM {events} WHERE event_type = 'view'), r AS (SELECT user_id, event_id, tier, row_number() OVER (PARTITION BY user_id ORDER BY tier, value DESC, event_id) AS rank FROM a) SELECT user_id, event_id, tier, rank FROM r WHERE rank <= 5"),
    "trust_scores": (trust_scores, f"WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN -0.1::DOUBLE ELSE 0.1::DOUBLE END AS d FROM events), {_FOLD.format(lists=_list('d') + ' AS ds')} SELECT event_id, list_reduce(list_prepend(0.5::DOUBLE, ds[1:i + 1]), lambda a, y: round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + y)), 6)) AS trust FROM x"),
    "scar_bias": (scar_bias, f"WITH n AS (SELECT *, row_number() OVER ({U}) AS n FROM events), e AS (SELECT *, CASE WHEN event_type <> 'error' THEN 0 WHEN n - max(CASE WHEN event_type = 'error' THEN n END) OVER ({U} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1001 THEN 0.25 ELSE 0.15 END::DOUBLE AS d FROM n), {_FOLD.format(lists=_list('d') + ' AS ds')} SELECT event_id, list_reduce(list_prepend(1.0::DOUBLE, ds[1:i + 1]), lambda a, y: round(CASE WHEN y > 0 THEN least(2.0::DOUBLE, a + y) ELSE greatest(1.0::DOUBLE, a * 0.999::DOUBLE) END, 6)) AS bias FROM x"),
    "ledger_chain": (ledger_chain, f"WITH e AS (SELECT *, event_id::VARCHAR || '|' || event_type AS d FROM events), {_FOLD.format(lists=_list('d') + ' AS ds')} SELECT event_id, list_reduce(list_prepend('genesis', ds[1:i + 1]), lambda a, y: sha256(a || '|' || y)) AS digest FROM x"),
    "ledger_verify": (ledger_verify, "SELECT user_id, count(*) AS good, count(*) AS n FROM events GROUP BY 1"),
}
