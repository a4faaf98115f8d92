"""Queries over the event stream as an audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakflow.functions import places
from leakflow.operators import audit, graph
from leakflow.plans.registry import query, read
from leakflow.session import staged

_FIELDS = ["ts", "user_id", "event_type", "value"]
_NANOS = "cast(floor(value * 1000) as bigint)"


@query("rule_stats", "SELECT event_type AS rule_id, sum(floor(value * 1000)::BIGINT)::BIGINT AS total, count(*)::BIGINT AS hits, floor(sum(floor(value * 1000)::BIGINT) / count(*))::BIGINT AS average FROM events GROUP BY event_type")
def rule_stats(spark, sf_dir):
    return audit.timing_stats(read(spark, sf_dir, "events"), "event_type", F.expr(_NANOS))


@query("status_counts", "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def _log(spark, sf_dir):
    """Events whose chain fields are text, one chain for each user."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "event_type", F.expr(_NANOS).alias("value"))


@query(
    "hash_chain_build",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
      chr(31) || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(31) || user_id || chr(31) || event_type || chr(31) || floor(value * 1000)::BIGINT AS t FROM events),
    c AS (SELECT user_id, event_id, rn, '' AS prev_hash, sha256(t) AS row_hash FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, c.row_hash, sha256(c.row_hash || e.t) FROM c JOIN e ON e.user_id = c.user_id AND e.rn = c.rn + 1)
    SELECT user_id, event_id, prev_hash, row_hash FROM c""",
)
def hash_chain_build(spark, sf_dir):
    return audit.build_chain(_log(spark, sf_dir), "user_id", "event_id", _FIELDS).select("user_id", "event_id", "prev_hash", "row_hash")


@query(
    "hash_chain_verify",
    """WITH e AS (SELECT user_id, event_id FROM events), bad AS (SELECT user_id, min(event_id) AS first_broken FROM e WHERE event_id % 97 = 0 GROUP BY user_id)
    SELECT e.user_id, count(*)::BIGINT AS checked, 0::BIGINT AS legacy, any_value(first_broken) AS first_broken FROM e LEFT JOIN bad USING (user_id) GROUP BY e.user_id""",
)
def hash_chain_verify(spark, sf_dir):
    chained = audit.build_chain(_log(spark, sf_dir), "user_id", "event_id", _FIELDS)
    touched = chained.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return audit.verify_chain(touched, "user_id", "event_id", _FIELDS)


@query(
    "hash_chain_one",
    """WITH e AS (SELECT row_number() OVER (ORDER BY event_id) AS n, event_id, event_id % 50 = 7 AS legacy FROM events)
    SELECT 'all' AS chain, count(*) FILTER (NOT legacy)::BIGINT AS checked, count(*) FILTER (legacy)::BIGINT AS legacy, min(event_id) FILTER (event_id % 997 = 500 AND NOT legacy) AS first_broken FROM e""",
)
def hash_chain_one(spark, sf_dir):
    """One chain of all events, some of them from before there were hashes, one in 997 changed afterwards: verified by many tasks."""
    log = _log(spark, sf_dir).withColumn("chain", F.lit("all"))
    old = log.filter("event_id % 50 = 7").withColumn("prev_hash", F.lit("")).withColumn("row_hash", F.lit(""))
    chained = audit.build_chain(log.filter("event_id % 50 <> 7"), "chain", "event_id", _FIELDS).unionByName(old)
    touched = staged(chained.withColumn("value", F.when(F.col("event_id") % 997 == 500, F.col("value") + 1).otherwise(F.col("value"))), "chain")
    return audit.verify_chain(touched, "chain", "event_id", _FIELDS)


_TURN = "chr(31) || conv_id || chr(31) || turn || chr(31) || coalesce(role, '') || chr(31) || coalesce(text, '')"


@query(
    "chain_append",
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, turn, role, text) AS n, {_TURN} AS x FROM conversations),
    c AS (SELECT conv_id, turn, n, '' AS prev_hash, sha256(x) AS row_hash FROM t WHERE n = 1 UNION ALL SELECT t.conv_id, t.turn, t.n, c.row_hash, sha256(c.row_hash || t.x) FROM c JOIN t ON t.conv_id = c.conv_id AND t.n = c.n + 1)
    SELECT conv_id, turn, n AS number, prev_hash, row_hash FROM c""",
)
def chain_append(spark, sf_dir):
    """Conversations as chains that three runs of a stream append to, each after a restart."""
    from leakflow.session import new_path
    from leakflow.streaming import scans

    home = new_path(spark, "append")
    rows = read(spark, sf_dir, "conversations").withColumn("part", F.col("turn") % 3)
    rows = rows.withColumn("place", F.concat(F.lpad(F.col("turn").cast("string"), 12, "0"), F.lit(" "), F.coalesce("role", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    return scans.run_in_parts(rows, "part", home, lambda stream: audit.append_chain(stream, "conv_id", "place", ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "number", "prev_hash", "row_hash"), audit.STATE_STORE)


@query("audit_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def audit_tail(spark, sf_dir):
    return audit.tail(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 20)


@query("audit_search", "SELECT event_id FROM events WHERE contains(lower(concat_ws(' ', event_type, user_id::VARCHAR)), 'click 1')")
def audit_search(spark, sf_dir):
    return audit.search(read(spark, sf_dir, "events"), ["event_type", "user_id"], "CLICK 1").select("event_id")


@query("audit_viewport", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 15 OFFSET 40")
def audit_viewport(spark, sf_dir):
    return audit.viewport(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 40, 15)


@query("repo_state_caps", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 200")
def repo_state_caps(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return graph.newest(rows, "event_type", [F.desc("ts"), F.desc("event_id")], 200).select("event_type", "event_id")


@query(
    "policy_verdict",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'blocked:alias' WHEN event_id % 13 = 0 THEN 'blocked:rewrite'
      WHEN c IN ('push', 'fetch', 'pull', 'clone') AND user_id % 5 = 0 THEN 'blocked:remote' WHEN c IN ('commit', 'push') AND value > 100 THEN 'blocked:secret' ELSE 'allowed' END AS verdict
    FROM (SELECT *, CASE user_id % 4 WHEN 0 THEN 'push' WHEN 1 THEN 'commit' WHEN 2 THEN 'fetch' ELSE 'log' END AS c FROM events)""",
)
def policy_verdict(spark, sf_dir):
    command = F.element_at(F.array(*map(F.lit, ("push", "commit", "fetch", "log"))), (F.col("user_id") % 4 + 1).cast("int"))
    argv = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("-c alias.x=!sh "), command)).when(F.col("event_id") % 13 == 0, F.concat(F.lit("-c url.a.insteadOf=b "), command)).otherwise(command)
    judged = audit.verdict(read(spark, sf_dir, "events"), command, argv, F.col("user_id") % 5 != 0, F.col("value") > 100)
    return judged.select("event_id", "verdict")


@query("severity_rollup", "SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 0 END) WHEN 2 THEN 'purchase' WHEN 1 THEN 'click' WHEN 0 THEN 'view' END AS worst FROM events GROUP BY user_id")
def severity_rollup(spark, sf_dir):
    """The worst event of each user; types without a rank don't count, and a user of none but such has none."""
    return audit.worst(read(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "purchase"])


@query("argv_command", "SELECT event_id, 'git ' || event_type || ' ' || user_id AS command FROM events")
def argv_command(spark, sf_dir):
    argv = F.to_json(F.array(F.lit("git"), F.col("event_type"), F.col("user_id").cast("string")))
    return read(spark, sf_dir, "events").select("event_id", places.command_text(argv).alias("command"))


@query("events_by_hour", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def events_by_hour(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


_DAYS = 9
_COMES_SQL = f"""e AS (SELECT *, (epoch(ts)::BIGINT // 86400) // {_DAYS} AS block FROM events), b AS (SELECT max(block) AS last FROM e), c AS (SELECT e.*, CASE WHEN event_id % 50 = 7 THEN last ELSE block END AS part, last FROM e, b),
    w AS (SELECT coalesce(max(ts) FILTER (part < last), TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR AS late, max(ts) - INTERVAL 2 HOUR AS done FROM c)"""


@query(
    "event_windows",
    f"""WITH {_COMES_SQL}, h AS (SELECT *, date_trunc('hour', ts) AS window_start FROM c) SELECT window_start, event_type, count(*)::BIGINT AS n FROM h, w
    WHERE window_start + INTERVAL 1 HOUR <= done AND NOT (event_id % 50 = 7 AND window_start + INTERVAL 1 HOUR <= late) GROUP BY ALL""",
)
def event_windows(spark, sf_dir):
    """Events that a stream takes some days at a time, one in fifty only with the last of them: windows are closed by the watermark, and rows that come too late don't count."""
    from leakflow.session import new_path
    from leakflow.streaming import scans

    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    block = F.expr(f"cast(unix_seconds(ts) div 86400 div {_DAYS} as int)")
    last = events.agg(F.max(block)).first()[0]
    comes = events.select("ts", "event_type", F.when(F.col("event_id") % 50 == 7, F.lit(last)).otherwise(block).alias("part"))
    made = scans.run_in_parts(comes, "part", new_path(spark, "windows"), lambda s: scans.windowed_counts(s, "ts", "event_type"))
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("streaming_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedupe(spark, sf_dir):
    """First events of each user and type, found by a stream over the table; rows and checkpoint lie in the shared folder."""
    from leakflow.session import new_path
    from leakflow.streaming import scans

    path = new_path(spark, "dedupe")
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = scans.first_seen(stream, ["user_id", "event_type"]).select("user_id", "event_type")
    query_ = found.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query_.awaitTermination()
    return spark.read.schema(found.schema).parquet(path)
