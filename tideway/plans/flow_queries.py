"""Registered queries on labels, packets, windows and exports, each with SQL that gives the same rows.

``QUERIES[name] = (function, sql)``; the SQL is written plainly, without the rewrites that the operators use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.functions import labels, values
from tideway.operators import flows, metrics, sampling, sketches, windows
from tideway.plans.adapters import event_packets, line_packets, order_category, order_exports, table
from tideway.sources import capture

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# --- SQL building blocks --------------------------------------------------------------------------------------


# The label rules once more, written out, so that a wrong entry in the operators' tables shows.
_SQL_SERVICES = "('streaming','gaming','conferencing','bulk_transfer','browsing','xr_interactive','iot_security','unknown')"
_SQL_APPS = (
    ("streaming", ("youtube", "youtube_live", "netflix", "prime_video", "primevideo", "amazon_prime", "twitch", "naver_now", "afreecatv", "crave", "video_streaming", "streaming")),
    ("gaming", ("valorant", "val", "league_of_legends", "lol", "teamfight_tactics", "tft", "roblox", "minecraft", "battleground", "geforce_now", "kt_gamebox", "fortnite")),
    ("gaming", ("forza_horizon_5", "mortal_kombat_11", "cloud_gaming", "gaming")),
    ("conferencing", ("zoom", "teams", "google_meet", "discord", "voip", "conferencing")),
    ("bulk_transfer", ("download", "file_download", "ftp", "bulk", "bulk_transfer")),
    ("browsing", ("web", "web_browsing", "browsing")),
    ("xr_interactive", ("vr", "ar", "xr", "metaverse", "zepeto", "cloud_vr", "vr_video", "xr_interactive")),
    ("iot_security", ("benign", "ddos", "dos", "recon", "web_attack", "bruteforce", "brute_force", "spoofing", "mirai")),
)
_SQL_ALIASES = (
    "WHEN 'yt' THEN 'youtube' WHEN 'prime' THEN 'prime_video' WHEN 'lol' THEN 'league_of_legends' WHEN 'tft' THEN 'teamfight_tactics' "
    "WHEN 'meet' THEN 'google_meet' WHEN 'http_download' THEN 'file_download' WHEN 'cloudvr' THEN 'cloud_vr'"
)
_SQL_BROWSING = (
    "('search','social','blogs_news','e_commerce','mail','advertising','authentication_services','analytics_telemetry','information_systems',"
    "'instant_messaging','other_services_and_apis','antivirus')"
)
_SQL_PATHS = (
    "youtube_live", "youtube", "netflix", "amazon_prime", "zoom", "ms_teams", "google_meet", "roblox", "zepeto", "battleground", "teamfight_tactics", "geforce_now", "kt_gamebox", "naver_now", "afreecatv",
)
_SQL_PRIVATE = ("10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.30.", "172.31.")


def sql_norm(c: str) -> str:
    text = f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'unknown' ELSE {c} END"
    text = f"replace(translate(lower(regexp_replace({text}, '^\\s+|\\s+$', '', 'g')), '/- ', '___'), '__', '_')"
    return f"(CASE {text} {_SQL_ALIASES} ELSE {text} END)"


def sql_service(token: str) -> str:
    """The service of a label that is normalised already."""
    exact = " ".join(f"WHEN '{app}' THEN '{service}'" for service, apps in _SQL_APPS for app in apps)
    pairs = ", ".join(f"{{'app': '{app}', 'service': '{service}'}}" for service, apps in _SQL_APPS for app in apps)
    contained = f"list_filter([{pairs}], lambda x: contains({token}, x.app))[1].service"
    return f"coalesce(CASE WHEN {token} IN {_SQL_SERVICES} THEN {token} END, CASE {token} {exact} END, {contained}, 'unknown')"


def sql_category(token: str, again: str) -> str:
    """The service of a category that is normalised already; ``again`` is it normalised once more."""
    return f"""(CASE WHEN {token} IN ('streaming_media', 'music') THEN 'streaming' WHEN {token} = 'games' THEN 'gaming' WHEN {token} = 'videoconferencing' THEN 'conferencing'
 WHEN {token} = 'file_sharing' THEN 'bulk_transfer' WHEN {token} IN {_SQL_BROWSING} THEN 'browsing' ELSE {sql_service(again)} END)"""


def sql_condition(rtt: str, jitter: str, loss: str) -> str:
    score = " + ".join(f"CASE WHEN {v} > {limit} THEN 1 ELSE 0 END" for v, limit in ((rtt, 80), (rtt, 180), (jitter, 25), (loss, 0.01), (loss, 0.04)))
    return f"(CASE WHEN {score} <= 0 THEN 'good' WHEN {score} <= 2 THEN 'moderate' WHEN {score} <= 4 THEN 'degraded' ELSE 'bad' END)"


def sql_key(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT)"


RAW_LABELS = """SELECT p_partkey AS id, CASE p_partkey % 16
  WHEN 0 THEN p_type WHEN 1 THEN ' YouTube ' || p_name WHEN 2 THEN 'Cloud-Gaming' WHEN 3 THEN p_brand || '/' || p_type WHEN 4 THEN NULL WHEN 5 THEN ''
  WHEN 6 THEN 'yt' WHEN 7 THEN 'http download' WHEN 8 THEN 'Web  Browsing' WHEN 9 THEN 'a--b____' || p_name WHEN 10 THEN 'MEET' WHEN 11 THEN 'lol'
  WHEN 12 THEN 'my zoom ' || p_type WHEN 13 THEN '   ' WHEN 14 THEN 'Streaming/Media' ELSE 'file-sharing' END AS raw FROM part"""


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("tideway_part")
    return spark.sql(RAW_LABELS.replace("FROM part", "FROM tideway_part"))


_TWICE = f"(SELECT *, {sql_norm('label')} AS again FROM (SELECT id, {sql_norm('raw')} AS label FROM ({RAW_LABELS})))"


@query(f"SELECT id, label, {sql_service('label')} AS service, {sql_category('label', 'again')} AS category_service FROM {_TWICE}")
def p1_p2_p3_labels(spark, sf_dir):
    rows = raw_labels(spark, sf_dir)
    return rows.select("id", labels.normalize_label("raw").alias("label"), labels.infer_service("raw").alias("service"), labels.service_from_category("raw").alias("category_service"))


_TOKEN_CASE = " ".join(f"WHEN contains(lower(path), '{t}') THEN '{t}'" for t in _SQL_PATHS)
_PATHS = "SELECT id, '/in/' || coalesce(raw, 'none') || '/' || CASE id % 3 WHEN 0 THEN 'youtube_live' WHEN 1 THEN 'GeForce_Now x' ELSE 'part' END || '.csv' AS path FROM ({})"


@query(f"SELECT id, CASE {_TOKEN_CASE} ELSE {sql_norm('string_split(path, chr(47))[-2]')} END AS app FROM ({_PATHS.format(RAW_LABELS)})")
def p4_app_from_path(spark, sf_dir):
    raw_labels(spark, sf_dir).createOrReplaceTempView("tideway_labels")
    return spark.sql(_PATHS.format("SELECT * FROM tideway_labels")).select("id", labels.app_from_path("path").alias("app"))


_PROTOCOLS = """SELECT event_id, CASE event_id % 12 WHEN 0 THEN ' UDP ' WHEN 1 THEN 'quic-v1' WHEN 2 THEN 'TLSv1.3' WHEN 3 THEN 'https' WHEN 4 THEN '17' WHEN 5 THEN '6.0'
  WHEN 6 THEN CAST(user_id AS VARCHAR(20)) WHEN 7 THEN 'inf' WHEN 8 THEN NULL WHEN 9 THEN 'nan' WHEN 10 THEN 'tcpish' ELSE event_type END AS proto FROM events"""
_TEXT = "lower(trim(proto))"


@query(f"""SELECT event_id, CASE WHEN {_TEXT} IN ('udp','quic','dns','rtp','17') OR {_TEXT} LIKE 'quic%' THEN 17
  WHEN {_TEXT} IN ('tcp','tls','ssl','http','https','6') OR {_TEXT} LIKE 'tcp%' OR {_TEXT} LIKE 'tls%' THEN 6
  WHEN TRY_CAST({_TEXT} AS DOUBLE) IS NOT NULL AND isfinite(TRY_CAST({_TEXT} AS DOUBLE)) THEN trunc(TRY_CAST({_TEXT} AS DOUBLE))::INT ELSE 0 END AS protocol FROM ({_PROTOCOLS})""")  # fmt: skip
def p5_protocol_number(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("tideway_events")
    return spark.sql(_PROTOCOLS.replace("FROM events", "FROM tideway_events")).select("event_id", labels.protocol_number("proto").alias("protocol"))


_ADDRESS = """SELECT l_orderkey, l_linenumber, CASE l_suppkey % 6 WHEN 0 THEN '10.' WHEN 1 THEN '172.' || l_linenumber || '.' WHEN 2 THEN '172.2' WHEN 3 THEN '192.168.' WHEN 4 THEN '172.3' ELSE '8.' END || l_suppkey AS src,
  CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '172.' || (l_partkey % 40) || '.1.1' WHEN 2 THEN '10.0.0.1' ELSE '1.1.1.1' END AS dst FROM lineitem"""


def _sql_private(c: str) -> str:
    return "coalesce(" + " OR ".join(f"starts_with({c}, '{p}')" for p in _SQL_PRIVATE) + ", false)"


@query(f"SELECT src, dst, {_sql_private('src')} AS src_private, {_sql_private('dst')} AS dst_private, CASE WHEN NOT {_sql_private('src')} AND {_sql_private('dst')} THEN -1 ELSE 1 END AS direction, count(*) AS n FROM ({_ADDRESS}) GROUP BY ALL")
def p6_p7_direction(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tideway_lineitem")
    rows = spark.sql(_ADDRESS.replace("FROM lineitem", "FROM tideway_lineitem"))
    rows = rows.select("src", "dst", labels.is_private("src").alias("src_private"), labels.is_private("dst").alias("dst_private"), labels.direction("src", "dst").alias("direction"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


_TIMES = """SELECT event_id, user_id % 20 AS file, CASE WHEN user_id % 20 < 10 THEN CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR(20)) END
  ELSE '2024-01-0' || CAST(1 + event_id % 9 AS VARCHAR(1)) || 'é 10:00:' || CAST(10 + event_id % 50 AS VARCHAR(2)) END AS time FROM events"""


@query(f"""WITH rows AS ({_TIMES}), files AS (SELECT file, count(TRY_CAST(time AS DOUBLE)) >= greatest(1, count(*) // 2) AS numeric_file FROM rows GROUP BY file)
SELECT event_id, round(CASE WHEN numeric_file THEN TRY_CAST(time AS DOUBLE) ELSE epoch(strptime(replace(time, 'é', ''), '%Y-%m-%d %H:%M:%S')) END, 6) AS ts FROM rows JOIN files USING (file)""")
def p8_epoch_seconds(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("tideway_events")
    rows = spark.sql(_TIMES.replace("FROM events", "FROM tideway_events"))
    rows = rows.join(windows.numeric_time_files(rows), "file")
    return rows.select("event_id", F.round(values.epoch_seconds(F.col("time"), F.col("numeric_file")), 6).alias("ts"))


EVENT_PACKETS = """SELECT user_id::VARCHAR AS file, event_id AS seq, 1.0::DOUBLE + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 1e6::DOUBLE / 1e5::DOUBLE AS ts,
  least(greatest(value * 10.0::DOUBLE, 0.0::DOUBLE), 65535.0::DOUBLE) AS length, CASE WHEN event_type IN ('view','click','signup') THEN 1 ELSE -1 END AS direction,
  CASE event_type WHEN 'click' THEN 17 WHEN 'view' THEN 6 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 17 ELSE 0 END AS protocol FROM events"""


@query("""SELECT event_id AS seq, round(least(greatest(value * 10.0 - 50.0, 0.0), 65535.0), 6) AS length FROM events
WHERE isfinite(value) AND (event_id % 7)::DOUBLE - 1.0 > 0""")
def p9_valid_packets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("value") * 10.0 - 50.0).alias("length"), (F.col("event_id") % 7 - 1.0).alias("ts"))
    return windows.valid_packets(rows).select("seq", F.round("length", 6).alias("length"))


_GROUP_SQL = """
placed AS ({placed}),
gaps AS (SELECT *, coalesce(greatest(0.0::DOUBLE, (ts - lag(ts) OVER w) * 1000.0::DOUBLE), 0.0::DOUBLE) AS iat, row_number() OVER w AS rn FROM placed WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
modes AS (SELECT {keys}, protocol, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, protocol) AS place FROM gaps GROUP BY {keys}, protocol),
stats AS (SELECT {keys}, count(*) AS n, count(*) FILTER (direction > 0) AS fwd, count(*) FILTER (direction <= 0) AS bwd, sum(length) AS len_sum, sum(length) / count(*) AS len_mean,
  sqrt(greatest(0.0::DOUBLE, sum(length * length) / count(*) - (sum(length) / count(*)) * (sum(length) / count(*)))) AS len_std, sum(iat) / count(*) AS iat_mean,
  sqrt(greatest(0.0::DOUBLE, sum(iat * iat) / count(*) - (sum(iat) / count(*)) * (sum(iat) / count(*)))) AS iat_std, {duration} AS duration,
  string_agg(CASE WHEN rn <= 128 THEN round(length * 10)::BIGINT::VARCHAR END, ',' ORDER BY rn) AS lengths, sum(CASE WHEN rn <= 128 THEN rn * direction END)::BIGINT AS ways
  FROM gaps GROUP BY {keys})
SELECT {shown}, {condition} AS condition, n AS total_packets, fwd, bwd, round(len_mean, 3) AS length_mean, round(len_std, 3) AS length_std, round(iat_mean, 3) AS iat_mean, round(iat_std, 2) AS iat_std,
  round(duration, 3) AS duration, round(len_sum / greatest(duration / 1000.0::DOUBLE, 0.001::DOUBLE), 2) AS bytes_s, round(n / greatest(duration / 1000.0::DOUBLE, 0.001::DOUBLE), 3) AS packets_s,
  protocol, lengths, ways FROM stats JOIN modes USING ({keys}) WHERE place = 1"""


def _shown(found: DataFrame, keys: list) -> DataFrame:
    return found.select(
        *keys,
        "condition",
        "total_packets",
        F.col("total_fwd_packets").alias("fwd"),
        F.col("total_bwd_packets").alias("bwd"),
        F.round("packet_length_mean", 3).alias("length_mean"),
        F.round("packet_length_std", 3).alias("length_std"),
        F.round("flow_iat_mean", 3).alias("iat_mean"),
        F.round("flow_iat_std", 2).alias("iat_std"),
        F.round("flow_duration", 3).alias("duration"),
        F.round("flow_bytes_s", 2).alias("bytes_s"),
        F.round("flow_packets_s", 3).alias("packets_s"),
        "protocol",
        F.array_join(F.transform("packet_lengths", lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("lengths"),
        F.aggregate("directions", F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("s")), lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["s"] + (a["i"] + 1) * x).alias("s")))["s"].alias("ways"),
    )


_W = "1.0::DOUBLE"
_BY_FILE = f"""SELECT *, round(((ts - origin) - (ts - origin) % {_W}) / {_W})::BIGINT AS window_id FROM (SELECT *, min(ts) OVER (PARTITION BY file) AS origin FROM packets)"""
FLOWS_SQL = f"WITH packets AS ({EVENT_PACKETS})," + _GROUP_SQL.format(
    placed=_BY_FILE, keys="file, window_id", order="ts, seq", duration="greatest(0.0, max(ts) - min(ts)) * 1000.0::DOUBLE", shown="file, window_id", condition=sql_condition("iat_mean", "iat_std", "0.0")
)


@query(FLOWS_SQL)
def w1_to_w8_flows_by_file(spark, sf_dir):
    return _shown(windows.flows_by_file(event_packets(spark, sf_dir), 1.0), ["file", "window_id"])


@query(f"SELECT file, window_id, total_packets, lengths, ways FROM ({FLOWS_SQL.replace('rn <= 128', 'rn <= 2')})")
def w6_series_cut_at_the_bound(spark, sf_dir):
    """Windows with more packets than the bound: counts go over all of them, series hold the first."""
    found = _shown(windows.flows_by_file(event_packets(spark, sf_dir), 1.0, max_packets=2), ["file", "window_id"])
    return found.select("file", "window_id", "total_packets", "lengths", "ways")


@query(f"SELECT condition, count(*) AS n, sum(total_packets)::BIGINT AS packets FROM ({FLOWS_SQL}) GROUP BY condition")
def flow_conditions(spark, sf_dir):
    """The flagship: packets to windows to conditions."""
    return windows.flows_by_file(event_packets(spark, sf_dir), 1.0).groupBy("condition").agg(F.count("*").alias("n"), F.sum("total_packets").alias("packets"))


_SECONDS = 366 * 86400.0
LINE_PACKETS = """SELECT year(l_shipdate)::VARCHAR AS trace, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS record_no, epoch(l_shipdate)::DOUBLE AS ts,
  CASE WHEN l_linestatus = 'O' THEN 17 ELSE 6 END AS proto, l_suppkey % 40 AS src, l_partkey % 40 AS dst, l_quantity * 30.0::DOUBLE AS length, l_returnflag <> 'N' AS accepted FROM lineitem"""
_BY_ENDS = f"""SELECT *, round(((ts - origin) - pmod) / {_SECONDS}::DOUBLE)::BIGINT AS window_id FROM (
  SELECT *, (((ts - origin) % {_SECONDS}::DOUBLE) + {_SECONDS}::DOUBLE) % {_SECONDS}::DOUBLE AS pmod FROM (
  SELECT *, proto AS protocol, least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src <= dst THEN 1 ELSE -1 END AS direction, first_value(ts) OVER (PARTITION BY trace ORDER BY record_no) AS origin FROM packets)) WHERE accepted"""


@query(f"WITH packets AS ({LINE_PACKETS})," + _GROUP_SQL.format(
    placed=_BY_ENDS, keys="trace, window_id, proto, a, b", order="record_no", duration="greatest(0.0, arg_max(ts, record_no) - arg_min(ts, record_no)) * 1000.0::DOUBLE", shown="trace, window_id, proto, a, b",
    condition=sql_condition("iat_mean", "iat_std", "0.0")))
def w3_p34_flows_by_endpoints(spark, sf_dir):
    found = windows.flows_by_endpoints(line_packets(spark, sf_dir), _SECONDS)
    return _shown(found, ["trace", "window_id", "proto", F.col("ep_a.ip").alias("a"), F.col("ep_b.ip").alias("b")])


@query(f"WITH packets AS ({EVENT_PACKETS}) SELECT seq, round(((ts - 2.0::DOUBLE) - pm) / 0.3::DOUBLE)::BIGINT AS window_id FROM (SELECT *, (((ts - 2.0::DOUBLE) % 0.3::DOUBLE) + 0.3::DOUBLE) % 0.3::DOUBLE AS pm FROM packets)")
def w2_window_ids(spark, sf_dir):
    return event_packets(spark, sf_dir).select("seq", windows.window_id(F.col("ts"), F.lit(2.0), 0.3).alias("window_id"))


@query(f"WITH packets AS ({LINE_PACKETS}) SELECT trace, count(*) AS scanned, count(*) FILTER (accepted) AS accepted FROM packets GROUP BY trace")
def s12_scan_counters(spark, sf_dir):
    return capture.scan_counters(line_packets(spark, sf_dir))


_LINES = """SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS way, l_quantity * 30.0::DOUBLE AS len,
  coalesce((epoch_us(l_shipdate)::DOUBLE / 8.64e10::DOUBLE - lag(epoch_us(l_shipdate)::DOUBLE / 8.64e10::DOUBLE) OVER w) * 20.0::DOUBLE, 0.0::DOUBLE) AS iat
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)"""
_CATEGORY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'streaming' WHEN '2-HIGH' THEN 'gaming' WHEN '3-MEDIUM' THEN 'conferencing' WHEN '4-NOT SPECIFIED' THEN 'bulk_transfer' ELSE 'browsing' END"
EXPORTS_SQL = f"""WITH lines AS ({_LINES}), series AS (SELECT l_orderkey, count(*) AS m, sum(iat) AS iat_sum, avg(iat) AS iat_mean, sqrt(avg(iat * iat) - avg(iat) * avg(iat)) AS iat_std, sum(len) AS len_sum,
  stddev_pop(len) AS len_std, sum(way)::BIGINT AS ways FROM lines GROUP BY l_orderkey), rows AS (SELECT o_orderkey, {sql_norm('o_orderstatus')} AS app, {_CATEGORY} AS service, s.*,
  greatest(o_totalprice / 1e5::DOUBLE * 1000.0::DOUBLE, iat_sum) AS duration, o_custkey % 5 AS fwd, o_custkey % 3 AS rev, greatest(o_custkey % 5 + o_custkey % 3, m, 1) AS packets, greatest(o_custkey::DOUBLE, len_sum) AS bytes
  FROM orders JOIN series s ON o_orderkey = l_orderkey)"""


@query(EXPORTS_SQL + f"""SELECT o_orderkey, app, service, {sql_condition('iat_mean', 'iat_std', '0.0')} AS condition, m AS n_series, ways, round(iat_mean, 3) AS rtt_ms, round(iat_std, 2) AS jitter_ms, packets AS total_packets, fwd, rev,
  round(bytes / packets, 3) AS length_mean, round(len_std, 3) AS length_std, round(duration, 5) AS duration, round(bytes / greatest(duration / 1000.0, 0.001), 2) AS bytes_s, 17 AS protocol FROM rows""")
def w11_p10_exported_flows(spark, sf_dir):
    found = flows.exported_flows(order_exports(spark, sf_dir))
    return found.select(
        "o_orderkey", "app", "service", "condition", F.size("packet_lengths").cast("long").alias("n_series"), F.aggregate("directions", F.lit(0).cast("long"), lambda s, x: s + x).alias("ways"),
        F.round("rtt_ms", 3).alias("rtt_ms"), F.round("jitter_ms", 2).alias("jitter_ms"), "total_packets", F.col("total_fwd_packets").alias("fwd"), F.col("total_bwd_packets").alias("rev"),
        F.round("packet_length_mean", 3).alias("length_mean"), F.round("packet_length_std", 3).alias("length_std"), F.round("flow_duration", 5).alias("duration"), F.round("flow_bytes_s", 2).alias("bytes_s"), "protocol",
    )


_ORDER_KEY = sql_key("'42'", "o_orderkey::VARCHAR")


@query(f"""WITH ranked AS (SELECT o_orderkey, {_CATEGORY} AS service, row_number() OVER (PARTITION BY {_CATEGORY} ORDER BY {_ORDER_KEY}, o_orderkey) AS turn FROM orders)
SELECT o_orderkey, service FROM ranked WHERE turn <= 100 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def d1_d2_balanced_exports(spark, sf_dir):
    """Sampled before any series is built or parsed (at most 100 orders a service go on); what does not parse goes afterwards."""
    orders = table(spark, sf_dir, "orders").withColumn("service", labels.service_from_category(order_category()))
    sampled = sampling.balanced_sample(orders, "service", 100, ["o_orderkey"]).drop("service")
    return flows.exported_flows(order_exports(spark, sf_dir, sampled)).select("o_orderkey", "service")


@query(EXPORTS_SQL + f"SELECT app, service, {sql_condition('iat_mean', 'iat_std', '0.0')} AS condition, count(*) AS n FROM rows GROUP BY ALL ORDER BY n DESC, app, service, condition LIMIT 30")
def s11_a1_run_summary(spark, sf_dir):
    return flows.run_summary(flows.exported_flows(order_exports(spark, sf_dir)))


@query(EXPORTS_SQL + f""", windows AS ({FLOWS_SQL}), united AS (SELECT service, m AS n FROM rows UNION ALL SELECT 'unknown', total_packets FROM windows)
SELECT service, count(*) AS n_rows, sum(CASE WHEN service = 'unknown' THEN 0 ELSE n END)::BIGINT AS labelled_series FROM united GROUP BY service""")
def s9_w12_labelled_set(spark, sf_dir):
    exported = flows.exported_flows(order_exports(spark, sf_dir))
    captured = flows.background(windows.flows_by_file(event_packets(spark, sf_dir), 1.0))
    known, rest = flows.labelled_set(exported, captured)
    both = known.select("service", F.size("packet_lengths").alias("n")).unionByName(rest.select("service", F.lit(0).alias("n")))
    return both.groupBy("service").agg(F.count("*").alias("n_rows"), F.sum("n").cast("long").alias("labelled_series"))


@query(f"""SELECT o_orderkey, {sql_condition("o_totalprice / 2000", "(o_custkey % 60)::DOUBLE", "(o_custkey % 9) / 100.0::DOUBLE")} AS condition,
 CASE {sql_condition("o_totalprice / 2000", "(o_custkey % 60)::DOUBLE", "(o_custkey % 9) / 100.0::DOUBLE")} WHEN 'good' THEN 0 WHEN 'moderate' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END AS condition_id FROM orders""")
def p16_p17_conditions(spark, sf_dir):
    condition = labels.infer_condition(F.col("o_totalprice") / 2000, (F.col("o_custkey") % 60).cast("double"), (F.col("o_custkey") % 9) / 100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", condition.alias("condition")).withColumn("condition_id", labels.condition_index("condition"))


@query(f"SELECT c_custkey, ('0x' || substr(sha256('a|' || c_custkey || '|' || c_name), 1, 8))::BIGINT AS seed, {sql_key(chr(39) + 'a' + chr(39), 'c_custkey::VARCHAR')} AS key FROM customer")
def p18_stable_seed(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", labels.stable_seed(F.lit("a"), F.col("c_custkey"), F.col("c_name")).alias("seed"), labels.stable_hash(F.lit("a"), F.col("c_custkey")).alias("key"))


@query("""SELECT o_orderkey, array_to_string(list_transform(series, lambda x: printf('%.2f', x)), ';') AS text, len(series) AS n, list_sum(series)::DOUBLE AS total, o_custkey % 4 <> 0 AS good FROM (
  SELECT o_orderkey, o_custkey, [o_custkey / 4.0::DOUBLE, (o_orderkey % 10)::DOUBLE, 1.5::DOUBLE] AS series FROM orders)""")
def p11_p12_series_text(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("series", F.array(F.col("o_custkey") / 4.0, (F.col("o_orderkey") % 10).cast("double"), F.lit(1.5)))
    rows = rows.withColumn("text", values.series_text(F.col("series"), 2))
    messy = F.translate("text", ";", "|")
    broken = F.when(F.col("o_custkey") % 4 == 0, F.concat(messy, F.lit(";x"))).otherwise(F.concat(messy, F.lit("; ")))
    back = values.parse_series(F.col("text"))
    return rows.select("o_orderkey", "text", F.size(back).cast("long").alias("n"), F.aggregate(back, F.lit(0.0), lambda s, x: s + x).alias("total"), values.parse_series(broken).isNotNull().alias("good"))


_FOREIGN = """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN '1,234.5' WHEN 1 THEN 'nan' WHEN 2 THEN NULL WHEN 3 THEN 'x' ELSE CAST(o_custkey AS VARCHAR(20)) END AS "Tot Fwd Pkts",
  CASE o_orderkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'inf' ELSE CAST(o_orderkey AS VARCHAR(20)) END AS "FWD PACKETS", o_orderstatus AS label, CAST(o_totalprice / 1000 AS VARCHAR(30)) AS rtt FROM orders"""
_F1, _F2 = "TRY_CAST(replace(\"Tot Fwd Pkts\", ',', '') AS DOUBLE)", "TRY_CAST(replace(\"FWD PACKETS\", ',', '') AS DOUBLE)"


@query(f"""SELECT o_orderkey, coalesce(CASE WHEN isfinite({_F1}) THEN {_F1} END, CASE WHEN isfinite({_F2}) THEN {_F2} END, 32.0::DOUBLE) AS fwd,
  coalesce("Tot Fwd Pkts", CASE WHEN trim("FWD PACKETS") <> '' THEN "FWD PACKETS" END) AS text, coalesce(CASE WHEN isfinite({_F2}) THEN {_F2} END, 7.0::DOUBLE) AS number FROM ({_FOREIGN})""")
def p13_p14_p15_foreign_columns(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("tideway_orders")
    rows = spark.sql(_FOREIGN.replace("FROM orders", "FROM tideway_orders").replace('"', "`"))
    names = ["total fwd packets", "tot fwd pkts", "fwd packets"]
    return rows.select("o_orderkey", values.number_of(rows, names, 32.0).alias("fwd"), values.text_of(rows, names).alias("text"), values.numeric(F.col("`FWD PACKETS`"), 7.0).alias("number"))


@query(f"SELECT id, label AS app, {sql_service('again')} AS service, {sql_condition('(id % 300)::DOUBLE', '5.0', '0.0')} AS condition FROM {_TWICE}")
def p20_p21_resolve_labels(spark, sf_dir):
    rows = raw_labels(spark, sf_dir).withColumnRenamed("raw", "Label").withColumn("RTT", (F.col("id") % 300).cast("double"))
    return flows.resolve_labels(rows).select("id", "app", "service", "condition")


_GIVEN = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Bad' WHEN 1 THEN ' moderate ' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'very-bad' ELSE 'good' END AS condition,
 (p_partkey % 300)::DOUBLE AS rtt, p_type AS label FROM part"""


@query(f"SELECT id, {sql_norm('label')} AS app, CASE WHEN condition IS NULL THEN {sql_condition('rtt', '5.0', '0.0')} ELSE {sql_norm('condition')} END AS condition FROM ({_GIVEN})")
def p21_given_conditions(spark, sf_dir):
    """A table that names its conditions keeps them, whatever its round-trip times say."""
    table(spark, sf_dir, "part").createOrReplaceTempView("tideway_part")
    rows = spark.sql(_GIVEN.replace("FROM part", "FROM tideway_part").replace("::DOUBLE", "")).withColumn("rtt", F.col("rtt").cast("double"))
    return flows.resolve_labels(rows).select("id", "app", "condition")


@query(f"WITH packets AS ({LINE_PACKETS}), ends AS (SELECT src, dst FROM packets) SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src <= dst THEN 1 ELSE -1 END AS direction, count(*) AS n FROM ends GROUP BY ALL")
def p34_canonical_keys(spark, sf_dir):
    low, high, way = windows.canonical_key(F.col("src"), F.col("dst"))
    rows = line_packets(spark, sf_dir).select(low["ip"].alias("a"), high["ip"].alias("b"), way.alias("direction"))
    return rows.groupBy("a", "b", "direction").agg(F.count("*").alias("n"))


@query("""WITH kinds AS (SELECT 'app' AS kind, p_type AS name, NULL AS place FROM part UNION SELECT 'service', p_brand, NULL FROM part UNION ALL
  SELECT 'service', name, place FROM (SELECT unnest(['streaming','gaming','conferencing','bulk_transfer','browsing','xr_interactive','iot_security','unknown']) AS name, generate_subscripts(['streaming','gaming','conferencing','bulk_transfer','browsing','xr_interactive','iot_security','unknown'], 1) AS place))
SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY place NULLS LAST, name) - 1 AS id FROM kinds""")
def a2_a3_p23_label_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("app"), F.col("p_brand").alias("service"))
    return metrics.label_map(rows, ("app", "service")).select("kind", "name", F.col("id").cast("long").alias("id"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 7 ELSE dense_rank() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END NULLS LAST) + 7 END AS service_id FROM part""")
def a4_j1_label_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_type").alias("service"))
    names = metrics.label_map(rows.where(F.col("p_size") % 3 != 0), ("service",))
    shown = rows.withColumn("service", F.when(F.col("p_size") % 3 == 0, "no such service").otherwise(F.col("service")))
    return metrics.label_ids(shown, names, "service").select("p_partkey", F.col("service_id").cast("long").alias("service_id"))


@query(f"WITH packets AS ({EVENT_PACKETS}), rows AS ({FLOWS_SQL}) SELECT round(avg(duration), 2) AS mean, round(quantile_cont(duration, 0.5), 2) AS p50, round(quantile_cont(duration, 0.95), 2) AS p95, round(quantile_cont(duration, 0.99), 2) AS p99 FROM rows")
def a8_percentiles(spark, sf_dir):
    found = metrics.summary_percentiles(windows.flows_by_file(event_packets(spark, sf_dir), 1.0), "flow_duration")
    return found.select(*[F.round(c, 2).alias(c) for c in found.columns])


@query("""SELECT 'users' AS name, count(DISTINCT user_id) AS exact, true AS within FROM events UNION ALL SELECT 'events', count(DISTINCT event_id), true FROM events
 UNION ALL SELECT 'value p' || p, count(*) FILTER (isfinite(value)), true FROM events, (VALUES (50), (95), (99)) ranks(p) GROUP BY p""")
def a2_a8_sketches_by_day(spark, sf_dir):
    """Distinct values and percentiles from sketches stored by day and merged, held against exact rows: whether each is within its bound."""
    events = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "value": F.when(F.abs("value") < float("inf"), F.col("value"))})
    found = sketches.estimates(sketches.merged(sketches.sketched(events, ["day"], ["user_id", "event_id"], ["value"])))
    exact = events.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"), F.count("value").alias("n"))
    at = [F.get("p_value", F.lit(i)) for i in range(3)]
    ranks = events.join(F.broadcast(found.select("p_value")), F.lit(True)).agg(  # one row
        *[F.array(F.count_if(F.col("value") < v), F.count_if(F.col("value") <= v)).alias(f"r{i}") for i, v in enumerate(at)]
    )
    one = found.join(exact, F.lit(True)).join(ranks, F.lit(True))  # a row each

    def close(estimate: str, truth: str):
        return F.abs(F.col(estimate) - F.col(truth)) <= sketches.DISTINCT_ERROR * F.col(truth)

    shown = [F.struct(F.lit(n).alias("name"), F.col(n).alias("exact"), close(e, n).alias("within")) for n, e in (("users", "n_user_id"), ("events", "n_event_id"))]
    for i, p in enumerate((50, 95, 99)):
        low, high = (F.get(f"r{i}", F.lit(j)) / F.col("n") for j in (0, 1))
        within = (low - sketches.QUANTILE_ERROR <= p / 100) & (high + sketches.QUANTILE_ERROR >= p / 100)
        shown.append(F.struct(F.lit(f"value p{p}").alias("name"), F.col("n").alias("exact"), within.alias("within")))
    return one.select(F.explode(F.array(*shown)).alias("x")).select("x.*")


@query("SELECT event_type AS name, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def s11_frequencies_by_day(spark, sf_dir):
    """How often each kind of event occurs, from a sketch stored by day; so few kinds share no cell in all lines, so the bound is the number."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("name"))
    sketch = sketches.frequency_sketch(events, ["day"], "name")
    return sketches.frequencies(sketch, events.where("name is not null"), "name").select("name", F.col("most").alias("n"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events) WHERE turn <= 25")
def a9_a10_top_per_group(spark, sf_dir):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("turn", turn).where("turn <= 25").select("event_type", "event_id", "value").orderBy("event_type", F.desc("value"), "event_id")


@query(f"SELECT event_id FROM events ORDER BY {sql_key(chr(39) + '42' + chr(39), 'event_id::VARCHAR')}, event_id LIMIT 500")
def d3_uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(table(spark, sf_dir, "events").select("event_id"), 500, ["event_id"])


_EVENT_KEY = sql_key("'42'", "event_id::VARCHAR")


@query(f"""WITH ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_EVENT_KEY}, event_id) AS turn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, CASE WHEN turn <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.15::DOUBLE, 0)) ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM ranked""")
def d4_stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 0.15, ["event_id"])


@query(f"SELECT event_id, CASE WHEN {_EVENT_KEY} < floor(0.2::DOUBLE * 4503599627370496)::BIGINT THEN 'test' ELSE 'train' END AS split FROM events")
def d4_hash_split(spark, sf_dir):
    return sampling.hash_split(table(spark, sf_dir, "events").select("event_id"), 0.2, ["event_id"])


@query(f"""WITH rows AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'rare' ELSE event_type END AS label, {_EVENT_KEY} AS k FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, event_id) AS turn FROM rows), per AS (SELECT greatest(1, 1500 // count(DISTINCT label)) AS each FROM rows),
first AS (SELECT event_id, label FROM ranked, per WHERE turn <= each), rest AS (SELECT event_id, label, row_number() OVER (ORDER BY k, event_id) AS place FROM ranked, per WHERE turn > each)
SELECT event_id, label FROM first UNION ALL SELECT event_id, label FROM rest WHERE place <= 1500 - (SELECT count(*) FROM first)""")
def d5_j4_j5_stratified_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, "rare").otherwise(F.col("event_type")).alias("label"))
    return sampling.stratified_cap(rows, "label", 1500, ["event_id"])


@query(f"SELECT event_id, (row_number() OVER (ORDER BY {sql_key(chr(39) + 'epoch3' + chr(39), 'event_id::VARCHAR')}, event_id) - 1) // 256 AS batch FROM events")
def d7_shuffled_batches(spark, sf_dir):
    return sampling.shuffled_batches(table(spark, sf_dir, "events").select("event_id"), 256, ["event_id"], 3)


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 100")
def p22_s6_first_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(100).select("event_id", "user_id")


@query("""SELECT user_id % 12 AS epoch, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY ALL""")
def a5_history_means(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("epoch"), F.col("event_type").alias("metric"), "value")
    return metrics.history_means(rows).withColumn("value", F.round("value", 6))
