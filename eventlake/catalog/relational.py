"""Expressions, aggregates, joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.catalog.base import (
    BAD_DAY,
    EC,
    ERRORS,
    EV,
    FIRST_DAY,
    HEALTH,
    MONTH,
    WEEK,
    between,
    layout,
    query,
    sql,
)
from eventlake.functions import (
    as_bigint,
    as_double,
    clock_bad,
    asked_days,
    day_from_path,
    duration_minutes,
    fail_pct,
    hash_uniform,
    in_window,
    json_path,
    json_schema,
    json_text,
    list_count,
    parse_count,
    utc_day,
)
from eventlake.operators import compare, distinct, quality, rollups
from eventlake.operators.dedupe import count_repeats, latest_per_key, one_per_key
from eventlake.plans import questions as ask
from eventlake.plans.layouts import with_conn
from eventlake.sources.events import device_events, error_codes


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- projections and filters ------------------------------------------------------------------

@query("enrich_with_conn", sql("SELECT event_id, conn FROM ev"))
def _(s, d):
    return with_conn(device_events(s, d)).select("event_id", "conn")


@query("all_columns_but_day", sql(
    """SELECT event_id, event_ts, ingested_at, device_id, device_model, os_version, firmware_version,
              country, event_type, error_code, status, duration_ms, payload FROM ev"""))
def _(s, d):
    return device_events(s, d).drop("day")


@query("columns_from_mapping", """SELECT o_orderkey AS id, o_orderdate AS received_at,
                                         o_orderstatus AS kind FROM orders""")
def _(s, d):
    names = {"id": "o_orderkey", "received_at": "o_orderdate", "kind": "o_orderstatus"}
    return table(s, d, "orders").select(*[F.col(src).alias(name) for name, src in names.items()])


@query("window_of_days", sql(f"SELECT day, count(*) AS events FROM ev WHERE {between(WEEK)} GROUP BY 1"))
def _(s, d):
    events = device_events(s, d, *WEEK).where(in_window(*WEEK))
    return events.groupBy("day").agg(F.count("*").alias("events"))


@query("open_ended_date_range", sql(
    "SELECT day, count(*) AS events FROM ev WHERE day >= DATE '2024-01-20' GROUP BY 1"))
def _(s, d):
    asked = asked_days(MONTH, first=FIRST_DAY.replace(day=20))
    return device_events(s, d, *asked).where(in_window(*asked)).groupBy("day").agg(
        F.count("*").alias("events"))


@query("predicates", sql(
    """SELECT event_id FROM ev
       WHERE (error_code IS NULL OR country NOT IN ('US', 'DE'))
         AND battery NOT BETWEEN 20 AND 30 AND (status = 'fail') = (error_code IS NOT NULL)"""))
def _(s, d):
    battery = json_text("payload", "battery").try_cast("int")
    return device_events(s, d).where(
        (F.col("error_code").isNull() | ~F.col("country").isin("US", "DE"))
        & ~battery.between(20, 30)
        & ~((F.col("status") == "fail") != F.col("error_code").isNotNull())
    ).select("event_id")


@query("one_in_n_slice", sql("SELECT event_id FROM ev WHERE event_id % 1000 = 0"))
def _(s, d):
    return device_events(s, d).where(F.col("event_id") % 1000 == 0).select("event_id")


@query("case_coalesce_nullif_least", sql(
    """SELECT event_id, CAST(coalesce(error_code, -1) AS INTEGER) AS code, nullif(conn, 'usb') AS not_usb,
              least(battery, 50) AS capped, CASE WHEN retries > 2 THEN 'many' ELSE 'few' END AS tries
       FROM ev"""))
def _(s, d):
    battery, retries = (json_text("payload", k).try_cast("int") for k in ("battery", "retries"))
    return with_conn(device_events(s, d)).select(
        "event_id", F.coalesce(F.col("error_code").cast("int"), F.lit(-1)).alias("code"),
        F.nullif("conn", F.lit("usb")).alias("not_usb"), F.least(battery, F.lit(50)).alias("capped"),
        F.when(retries > 2, "many").otherwise("few").alias("tries"))


@query("clock_check", sql(
    """SELECT event_id, (device_time > event_ts + INTERVAL 1 DAY
                         OR device_time < event_ts - INTERVAL 30 DAY) AS clock_bad
       FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN event_ts + (k - 50) * INTERVAL 1 DAY END
                       AS device_time FROM ev)"""))
def _(s, d):
    offset = F.make_dt_interval(days=json_text("props", "k").cast("int") - 50)
    device = F.when(F.col("event_id") % 11 != 0, F.col("ts") + offset)
    return table(s, d, "events").select("event_id", clock_bad(device, F.col("ts")).alias("clock_bad"))


@query("constant_columns", sql(
    "SELECT event_id, 'b1' AS batch, DATE '2024-01-30' AS loaded FROM ev"))
def _(s, d):
    return device_events(s, d).select(
        "event_id", F.lit("b1").alias("batch"), F.lit(BAD_DAY).alias("loaded"))


# ---- joins ------------------------------------------------------------------------------------

@query("failures_with_meaning", sql(
    """SELECT e.event_id, e.error_code, c.meaning FROM ev e JOIN ec c ON c.code = e.error_code""", EV, EC))
def _(s, d):
    events = device_events(s, d).select("event_id", "error_code")
    codes = error_codes(s)
    return events.join(codes, events["error_code"] == codes["code"]).drop("code")


@query("rollup_with_meaning", sql(
    """SELECT r.day, c.meaning, CAST(sum(r.failures) AS BIGINT) AS failures
       FROM errs r JOIN ec c ON c.code = r.error_code GROUP BY 1, 2""", EV, EC, ERRORS))
def _(s, d):
    daily, codes = rollups.rollup_daily_errors(device_events(s, d)), error_codes(s)
    joined = daily.join(codes, daily["error_code"] == codes["code"])
    return joined.groupBy("day", "meaning").agg(F.sum("failures").alias("failures"))


@query("bounded_self_join", sql(
    f"""SELECT device_id, count(*) AS pairs FROM ev a JOIN ev b USING (device_id)
        WHERE a.day = DATE '{WEEK[0]}' AND b.day = DATE '{BAD_DAY}' GROUP BY 1"""))
def _(s, d):
    # pairs are multiplied from counts per device, they are never formed
    def per_device(day, name):
        return device_events(s, d, day, day).groupBy("device_id").agg(F.count("*").alias(name))

    both = per_device(WEEK[0], "n_a").join(per_device(BAD_DAY, "n_b"), "device_id")
    return both.select("device_id", (F.col("n_a") * F.col("n_b")).alias("pairs"))


# ---- aggregates -------------------------------------------------------------------------------

@query("count_rows", sql("SELECT event_type, count(*) AS events FROM ev GROUP BY 1"))
def _(s, d):
    return device_events(s, d).groupBy("event_type").agg(F.count("*").alias("events"))


@query("sum_min_max_avg", sql(
    """SELECT event_type, CAST(sum(duration_ms) AS BIGINT) AS total, min(duration_ms) AS least,
              max(duration_ms) AS most, round(avg(duration_ms), 6) AS mean FROM ev GROUP BY 1"""))
def _(s, d):
    ms = F.col("duration_ms")
    return device_events(s, d).groupBy("event_type").agg(
        F.sum(ms).alias("total"), F.min(ms).alias("least"), F.max(ms).alias("most"),
        F.round(F.avg(ms), 6).alias("mean"))


@query("distinct_devices_per_day", sql(
    "SELECT day, count(DISTINCT device_id) AS devices FROM ev GROUP BY 1"))
def _(s, d):
    return device_events(s, d).groupBy("day").agg(F.countDistinct("device_id").alias("devices"))


@query("approx_distinct_close", sql("SELECT day, true AS close FROM ev GROUP BY 1"))
def _(s, d):
    counted = device_events(s, d).groupBy("day").agg(
        F.countDistinct("device_id").alias("exact"),
        F.approx_count_distinct("device_id", 0.02).alias("approx"))
    return counted.select("day", (F.abs(F.col("approx") - F.col("exact")) <= F.col("exact") * 0.25)
                          .alias("close"))


WINDOWS = {"all days": None, "one week": WEEK, "one day": (BAD_DAY, BAD_DAY)}


@query("distinct_exact_vs_approx", sql(
    f"""SELECT 'all days' AS "window", count(DISTINCT device_id) AS exact, true AS close FROM ev
        UNION ALL SELECT 'one week', count(DISTINCT device_id), true FROM ev WHERE {between(WEEK)}
        UNION ALL SELECT 'one day', count(DISTINCT device_id), true FROM ev WHERE day = DATE '{BAD_DAY}'"""))
def _(s, d):
    study = distinct.exact_and_approx(device_events(s, d), WINDOWS)
    return study.select("window", "exact", (F.col("error_pct") < 25).alias("close"))


@query("distinct_overcount", sql(
    f"""SELECT true_devices, added_up,
               round(CAST(100 AS DOUBLE) * (added_up - true_devices) / true_devices, 1) AS overcount_pct
        FROM (SELECT count(DISTINCT device_id) AS true_devices FROM ev
              WHERE {between(WEEK)} AND status = 'fail'),
             (SELECT CAST(sum(n) AS BIGINT) AS added_up FROM (
                SELECT count(DISTINCT device_id) AS n FROM ev
                WHERE {between(WEEK)} AND status = 'fail' GROUP BY day))"""))
def _(s, d):
    return distinct.overcount(device_events(s, d, *WEEK), *WEEK)


@query("distinct_from_merged_sketches", sql(
    f"""SELECT count(DISTINCT device_id) AS exact, true AS close FROM ev
        WHERE {between(WEEK)} AND status = 'fail'"""))
def _(s, d):
    events = device_events(s, d, *WEEK).where(in_window(*WEEK))
    merged = rollups.merge_device_sketches(rollups.rollup_device_sketches(events))
    exact = events.where("status = 'fail'").agg(F.countDistinct("device_id").alias("exact"))
    one = merged.select(F.lit(1).alias("one"), "devices").join(
        exact.select(F.lit(1).alias("one"), "exact"), "one")
    return one.select("exact", (F.abs(F.col("devices") - F.col("exact")) <= F.col("exact") * 0.05)
                      .alias("close"))


@query("filtered_aggregates", sql(
    """SELECT device_model, count(*) FILTER (WHERE status = 'fail') AS failures,
              CAST(sum(duration_ms) FILTER (WHERE status = 'ok') AS BIGINT) AS ok_ms FROM ev GROUP BY 1"""))
def _(s, d):
    ok = F.col("status") == "ok"
    return device_events(s, d).groupBy("device_model").agg(
        F.count_if(~ok).alias("failures"), F.sum(F.when(ok, F.col("duration_ms"))).alias("ok_ms"))


@query("fail_pct_per_day", sql(
    """SELECT day, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE status = 'fail') / count(*), 2)
              AS fail_pct FROM ev GROUP BY 1"""))
def _(s, d):
    failed = F.count_if(F.col("status") == "fail")
    return device_events(s, d).groupBy("day").agg(fail_pct(failed, F.count("*")).alias("fail_pct"))


@query("group_by_expression", sql("SELECT day = DATE '2024-01-30' AS bad, count(*) AS events FROM ev GROUP BY 1"))
def _(s, d):
    bad = (F.col("day") == F.lit(BAD_DAY)).alias("bad")
    return device_events(s, d).groupBy(bad).agg(F.count("*").alias("events"))


@query("having_many_devices", sql(
    """SELECT error_code, count(DISTINCT device_id) AS devices FROM ev WHERE status = 'fail'
       GROUP BY 1 HAVING count(DISTINCT device_id) > 2"""))
def _(s, d):
    per_code = device_events(s, d).where("status = 'fail'").groupBy("error_code").agg(
        F.countDistinct("device_id").alias("devices"))
    return per_code.where("devices > 2")


@query("aggregate_of_aggregate", sql(
    """SELECT max(n) AS busiest, min(n) AS quietest, round(avg(n), 6) AS mean
       FROM (SELECT device_id, count(*) AS n FROM ev GROUP BY 1)"""))
def _(s, d):
    per_device = device_events(s, d).groupBy("device_id").agg(F.count("*").alias("n"))
    return per_device.agg(F.max("n").alias("busiest"), F.min("n").alias("quietest"),
                          F.round(F.avg("n"), 6).alias("mean"))


@query("rollup_daily_health", sql("SELECT * FROM health", EV, HEALTH))
def _(s, d):
    return rollups.rollup_daily_health(device_events(s, d))


@query("rollup_daily_errors", sql("SELECT * FROM errs", EV, ERRORS))
def _(s, d):
    return rollups.rollup_daily_errors(device_events(s, d))


@query("rollup_to_coarser_keys", sql(
    "SELECT os_version, count(*) AS events, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms FROM ev GROUP BY 1"))
def _(s, d):
    daily = rollups.rollup_daily_health(device_events(s, d))
    return rollups.coarser(daily, ["os_version"], ["events", "total_duration_ms"])


@query("table_fingerprint", sql(
    """SELECT count(*) AS row_count, CAST(sum(event_id) AS VARCHAR) AS sum_event_id,
              CAST(sum(duration_ms) AS VARCHAR) AS sum_duration_ms,
              count(error_code) AS count_error_code, count(conn) AS count_conn FROM ev"""))
def _(s, d):
    print_ = compare.fingerprint(layout(s, d, "sorted"), ["event_id", "duration_ms"], ["error_code", "conn"])
    return print_.withColumns({c: F.col(c).cast("string") for c in ("sum_event_id", "sum_duration_ms")})


@query("repeat_count", """SELECT count(*) AS rows, count(*) - count(DISTINCT o_custkey) AS repeats,
                                 count(*) FILTER (WHERE nullif(o_orderstatus, 'O') IS NULL) AS rows_without_json
                          FROM orders""")
def _(s, d):
    orders = table(s, d, "orders").withColumn("text", F.nullif("o_orderstatus", F.lit("O")))
    return count_repeats(orders, "o_custkey", "text")


# ---- windows, order, limits -------------------------------------------------------------------

@query("latest_row_per_id", """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,
                                                               o_orderkey DESC) = 1""")
def _(s, d):
    orders = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest_per_key(orders, "o_custkey", "o_orderdate", [F.desc("o_orderkey")])


@query("one_row_per_key", """SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1""")
def _(s, d):
    return one_per_key(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("top_k_with_ties_broken", """SELECT l_partkey, count(*) AS n FROM lineitem
                                    GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25""")
def _(s, d):
    counted = table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "l_partkey").limit(25)


@query("nulls_last_order", sql(
    """SELECT event_id, error_code, CAST(row_number() OVER (PARTITION BY device_id, day ORDER BY error_code NULLS LAST, event_id) AS INTEGER) AS place FROM ev"""))
def _(s, d):
    # on most days a device has events with a code and events without one
    order = Window.partitionBy("device_id", "day").orderBy(F.asc_nulls_last("error_code"), "event_id")
    return device_events(s, d).select("event_id", "error_code", F.row_number().over(order).alias("place"))


@query("preview_rows", sql("SELECT event_id, event_ts, device_id, status FROM ev ORDER BY event_ts, event_id LIMIT 20"))
def _(s, d):
    events = device_events(s, d).select("event_id", "event_ts", "device_id", "status")
    return events.orderBy("event_ts", "event_id").limit(20)


# ---- set operations ---------------------------------------------------------------------------

@query("union_all_resent", sql(
    """SELECT status, count(*) AS rows FROM (
           SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE event_id % 1000 = 0) GROUP BY 1"""))
def _(s, d):
    events = device_events(s, d)
    both = events.unionByName(events.where("event_id % 1000 = 0"))
    return both.groupBy("status").agg(F.count("*").alias("rows"))


@query("union_distinct", sql(
    f"""SELECT device_id FROM ev WHERE day = DATE '{WEEK[0]}'
        UNION SELECT device_id FROM ev WHERE day = DATE '{BAD_DAY}'"""))
def _(s, d):
    days = [device_events(s, d, day, day).select("device_id") for day in (WEEK[0], BAD_DAY)]
    return days[0].union(days[1]).distinct()


@query("same_answer_rollup_and_raw", sql("SELECT count(*) AS differing FROM ev WHERE false"))
def _(s, d):
    events = device_events(s, d)
    raw = ask.failures_per_day(events, *MONTH)
    small = ask.failures_per_day_rollup(rollups.rollup_daily_health(events), *MONTH)
    return compare.differences(raw, small).agg(F.count("*").alias("differing"))


@query("differing_rows", """
    WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem),
         b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R')
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
           count(*) AS surplus
    FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2""")
def _(s, d):
    lines = table(s, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return compare.differences(lines.select(keys), lines.where("l_returnflag <> 'R'").select(keys))


@query("differing_rows_by_hash_tree", """
    WITH a AS (SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem)
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate,
           CAST(CASE WHEN l_orderkey % 1000 = 7 THEN 1 ELSE -1 END AS BIGINT) AS surplus
    FROM a WHERE l_orderkey % 1000 IN (7, 8)""")
def _(s, d):
    # the second table lacks some orders and has others twice
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("l_shipdate"))
    other = lines.where("l_orderkey % 1000 <> 7").unionByName(lines.where("l_orderkey % 1000 = 8"))
    return compare.tree_differences(lines, other, "l_shipdate")


# ---- scalar functions -------------------------------------------------------------------------

@query("json_field_text", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def _(s, d):
    return table(s, d, "events").select("event_id", json_text("props", "k").alias("k"))


@query("json_build", sql("SELECT event_id, payload FROM ev"))
def _(s, d):
    return device_events(s, d).select("event_id", "payload")


# the parts of one document, as text: a fraction, a list of objects, a missing item
NESTED = """{"info":{"Model":"m%s","Drain":%s.5},"networks":[{"state":"s%s"}],"usb":[%s]}"""


@query("json_nested_parse", """
    SELECT event_id, 'm' || k AS model, k + 0.5::DOUBLE AS drain, CAST(k + 1 AS BIGINT) AS drain_rounded,
           's' || k AS first_state, CAST(NULL AS VARCHAR) AS second_state,
           CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_usb
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def _(s, d):
    k = json_text("props", "k")
    usb = F.when(k.cast("int") % 2 == 0, '{"a":1},2').otherwise("")
    text = F.format_string(NESTED, k, k, k, usb)
    shape = json_schema([(("info", "Model"), T.StringType()), (("info", "Drain"), T.StringType()),
                         (("networks", 0, "state"), T.StringType()),
                         (("usb",), T.ArrayType(T.StringType()))])
    docs = table(s, d, "events").select("event_id", F.from_json(text, shape).alias("p"))
    p = F.col("p")
    drain = json_path(p, ("info", "Drain"))
    return docs.select(
        "event_id", json_path(p, ("info", "Model")).alias("model"), as_double(drain).alias("drain"),
        as_bigint(drain).alias("drain_rounded"),
        json_path(p, ("networks", 0, "state")).alias("first_state"),
        json_path(p, ("networks", 1, "state")).alias("second_state"),
        list_count(json_path(p, ("usb",))).alias("n_usb"))


@query("duration_text_to_minutes", """
    SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 4 * 10080 + k % 7 * 1440 + k % 24 * 60 + k END::BIGINT
           AS minutes
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def _(s, d):
    k = json_text("props", "k").cast("int")
    words = F.format_string("%s weeks, %s days, %s hours, %s minutes", k % 4, k % 7, k % 24, k)
    short = F.format_string("%sw %sd %sh %sm", k % 4, k % 7, k % 24, k)
    text = F.when(k % 5 == 0, "none").when(k % 2 == 0, words).otherwise(short)
    return table(s, d, "events").select("event_id", duration_minutes(text).alias("minutes"))


@query("casts_from_text", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS SMALLINT) AS k,
                                    TRY_CAST(event_type AS INTEGER) AS none FROM events""")
def _(s, d):
    return table(s, d, "events").select(
        "event_id", json_text("props", "k").try_cast("smallint").alias("k"),
        F.col("event_type").try_cast("int").alias("none"))


@query("utc_day_of_timestamp", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(s, d):
    zoned = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))
    return table(s, d, "events").select("event_id", utc_day(zoned).alias("day"))


@query("timestamp_arithmetic", """
    SELECT event_id, ts + INTERVAL 6 HOUR AS latest, ts + k * INTERVAL 1 SECOND AS shifted
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def _(s, d):
    k = json_text("props", "k").cast("int")
    return table(s, d, "events").select(
        "event_id", (F.col("ts") + F.make_dt_interval(hours=F.lit(6))).alias("latest"),
        (F.col("ts") + F.make_dt_interval(secs=k)).alias("shifted"))


@query("hash_uniform_spread", """SELECT count(*) AS rows, true AS in_range, true AS even, 0::BIGINT AS changed
                                 FROM events""")
def _(s, d):
    u = hash_uniform("event_id", salt=1, seed=7)
    ids = table(s, d, "events").select(u.alias("u"), hash_uniform("event_id", salt=1, seed=7).alias("again"))
    return ids.agg(
        F.count("*").alias("rows"), ((F.min("u") >= 0) & (F.max("u") < 1)).alias("in_range"),
        F.avg("u").between(0.4, 0.6).alias("even"), F.count_if(F.col("u") != F.col("again")).alias("changed"))


@query("math_functions", """
    SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, round(pow(value, 2), 6) AS squared,
           abs(value - 20) AS off, round(exp(value / 1000), 9) AS grown, user_id % 12 AS slot FROM events""")
def _(s, d):
    v = F.col("value")
    return table(s, d, "events").select(
        "event_id", F.floor(v).alias("whole"), F.round(F.pow(v, F.lit(2)), 6).alias("squared"),
        F.abs(v - 20).alias("off"), F.round(F.exp(v / 1000), 9).alias("grown"),
        (F.col("user_id") % 12).alias("slot"))


@query("list_lookup", sql("SELECT event_id, device_model, os_version, firmware_version, country FROM ev"))
def _(s, d):
    return device_events(s, d).select("event_id", "device_model", "os_version", "firmware_version", "country")


@query("concat_and_regex", sql(
    """SELECT event_id, device_model || '/' || error_code AS label,
              regexp_extract(os_version, '[0-9]+', 0) AS os_number,
              regexp_matches(os_version, '^win') AS windows FROM ev"""))
def _(s, d):
    return device_events(s, d).select(
        "event_id", F.concat("device_model", F.lit("/"), F.col("error_code").cast("string")).alias("label"),
        F.regexp_extract("os_version", "[0-9]+", 0).alias("os_number"),
        F.col("os_version").rlike("^win").alias("windows"))


@query("day_from_file_path", sql("SELECT CAST(day AS VARCHAR) AS folder_day, count(*) AS events FROM ev GROUP BY 1"))
def _(s, d):
    path = F.col("_metadata.file_path")
    days = layout(s, d, "by_day").select(day_from_path(path).alias("folder_day"))
    return days.groupBy("folder_day").agg(F.count("*").alias("events"))


@query("count_text_to_number", """
    SELECT event_id, CASE WHEN k = 0 THEN NULL WHEN k % 6 = 5 THEN NULL
                          WHEN k % 6 = 0 THEN k WHEN k % 6 = 1 THEN k * 1000
                          WHEN k % 6 = 2 THEN k * 1000000 + 500000 WHEN k % 6 = 3 THEN k * 1000000000
                          ELSE k * 1000 + 7 END AS rows
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def _(s, d):
    n = json_text("props", "k").cast("bigint")
    forms = ["%s", "%sK", " %s.5m", "%sb", "%s_007", "-%sM"]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(n % 6 == i, F.format_string(form, n)).otherwise(text)
    return table(s, d, "events").select("event_id", parse_count(text).alias("rows"))


# ---- data quality -----------------------------------------------------------------------------

@query("quality_report", sql(
    """SELECT unnest(['status and error code disagree', 'arrival time off', 'payload off',
                      'event id repeated', 'device attributes changed']) AS rule, 0::BIGINT AS bad_rows"""))
def _(s, d):
    return quality.quality_report(device_events(s, d))


@query("quality_report_of_damaged_events", sql(
    """, bad AS (SELECT * REPLACE (
             CASE WHEN event_id % 7 = 0 THEN NULL ELSE error_code END AS error_code,
             CASE WHEN event_id % 5 = 0 THEN event_ts + INTERVAL 7 HOUR ELSE ingested_at END AS ingested_at,
             CASE WHEN event_id % 3 = 0 THEN 'FR' ELSE country END AS country) FROM ev)
       SELECT 'status and error code disagree' AS rule,
              count(*) FILTER (WHERE (status = 'fail') <> (error_code IS NOT NULL)) AS bad_rows FROM bad
       UNION ALL SELECT 'arrival time off', count(*) FILTER (
              WHERE ingested_at < event_ts OR ingested_at > event_ts + INTERVAL 6 HOUR) FROM bad
       UNION ALL SELECT 'payload off', count(*) FROM bad WHERE conn NOT IN ('bluetooth', 'dongle', 'usb')
              OR battery NOT BETWEEN 5 AND 100 OR retries NOT BETWEEN 0 AND 3
       UNION ALL SELECT 'event id repeated', count(*) FROM bad WHERE event_id % 1000 = 0
       UNION ALL SELECT 'device attributes changed', count(*) FROM (
              SELECT device_id FROM bad GROUP BY 1 HAVING count(DISTINCT country) > 1)"""))
def _(s, d):
    events = device_events(s, d)
    bad = events.withColumns({
        "error_code": F.when(F.col("event_id") % 7 != 0, F.col("error_code")),
        "ingested_at": F.when(F.col("event_id") % 5 == 0, F.col("event_ts") + F.make_dt_interval(hours=F.lit(7)))
                        .otherwise(F.col("ingested_at")),
        "country": F.when(F.col("event_id") % 3 == 0, "FR").otherwise(F.col("country")),
    })
    # some events are sent twice; the second copy is fine in itself
    again = bad.where("event_id % 1000 = 0").withColumns({
        "error_code": F.when(F.col("status") == "fail", F.lit(1000)).cast("smallint"),
        "ingested_at": F.col("event_ts"),
    })
    return quality.quality_report(bad.unionByName(again))
