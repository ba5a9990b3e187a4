"""Queries for sources, coverage, cleaning and predicates."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning as op
from ..sources import tables as src
from .registry import query

LINE_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()),
    T.StructField("l_note", T.StringType()),
])


@query("read_source", "l_orderkey:i l_quantity:r l_returnflag:s l_note:s",
       "SELECT l_orderkey, l_quantity, l_returnflag, NULL AS l_note FROM lineitem")
def _(t):
    return src.read_source(t.spark, f"{t.folder}/lineitem.parquet", LINE_SCHEMA)


def monthly(t, df):
    path = src.scratch(t.spark)
    src.write_partitioned(df.withColumn("month", F.date_format("day", "yyyyMM")), path, "month")
    return path


@query("scan_panel", "day:d code:i close:r",
       "SELECT day, code, close FROM bars WHERE day BETWEEN DATE '1997-03-01' AND DATE '1999-06-01'")
def _(t):
    return src.scan_panel(t.spark, monthly(t, t.bars), "1997-03-01", "1999-06-01", ["day", "code", "close"])


@query("read_csv_ledger", "code:s day:d note:s close:r",
       "SELECT CAST(code AS VARCHAR) AS code, day, CASE WHEN close > open THEN 'up' ELSE '' END AS note, close FROM bars")
def _(t):
    path = src.scratch(t.spark)
    note = F.when(F.col("close") > F.col("open"), "up").otherwise("")
    t.bars.select(F.col("code").cast("string"), "day", note.alias("note"), "close").write.csv(
        path, header=True
    )
    schema = T.StructType([
        T.StructField("code", T.StringType()), T.StructField("day", T.DateType()),
        T.StructField("note", T.StringType()), T.StructField("close", T.DoubleType()),
    ])
    return src.read_csv_ledger(t.spark, path, schema)


@query("read_json_manifest", "code:i rows:i day:d amount:r",
       "SELECT code, count(*) OVER (PARTITION BY code, year(day)) AS rows, day, amount FROM bars")
def _(t):
    path = src.scratch(t.spark)
    # a code has at most twelve months per year
    part = F.struct(F.col("day").cast("string").alias("day"), "amount")
    t.bars.groupBy("code", F.year("day").alias("y")).agg(
        F.count(F.lit(1)).alias("rows"), F.collect_list(part).alias("partitions")
    ).write.option("ignoreNullFields", False).json(path)
    schema = "code bigint, rows bigint, y int, partitions array<struct<day:string,amount:double>>"
    df = t.spark.read.schema(schema).json(path)
    return df.select("code", "rows", F.inline("partitions"))


@query("write_partitioned", "month:i code:i close:r",
       "SELECT CAST(strftime(day, '%Y%m') AS INT) AS month, code, close FROM bars")
def _(t):
    return t.spark.read.parquet(monthly(t, t.bars))


@query("write_table_with_manifest", "month:i rows:i codes:i days:i",
       """SELECT CAST(strftime(day, '%Y%m') AS INT) AS month, count(*) AS rows, count(DISTINCT code) AS codes,
       count(DISTINCT day) AS days FROM bars GROUP BY 1""")
def _(t):
    df = t.bars.withColumn("month", F.date_format("day", "yyyyMM"))
    return src.write_table_with_manifest(df, src.scratch(t.spark), "month", {
        "rows": F.count(F.lit(1)), "codes": F.countDistinct("code"), "days": F.countDistinct("day"),
    })


def order_spans(t):
    return t.orders.select(
        F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("start"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("end"),
    )


SPANS = """SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 30 AS e FROM orders"""
ISLANDS = f"""SELECT code, min(s) AS s, max(e) AS e, count(*) AS parts FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(e) OVER (PARTITION BY code ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({SPANS})))
  GROUP BY code, g"""


@query("coverage_islands", "code:i start:d end_day:d parts:i",
       f'SELECT code, s AS start, e AS end_day, parts FROM ({ISLANDS})')
def _(t):
    return op.coverage_islands(order_spans(t), ["code"]).withColumnRenamed("end", "end_day")


@query("coverage_gaps", "code:i gap_start:d gap_end:d",
       f"""WITH i AS ({ISLANDS}), n AS (SELECT *, lead(s) OVER w AS nx, lag(e) OVER w AS pv FROM i WINDOW w AS (PARTITION BY code ORDER BY s))
       SELECT code, DATE '1995-01-01' AS gap_start, s - 1 AS gap_end FROM n WHERE pv IS NULL AND s > DATE '1995-01-01'
       UNION ALL SELECT code, greatest(e + 1, DATE '1995-01-01'), coalesce(nx - 1, DATE '2001-12-31') FROM n
       WHERE greatest(e + 1, DATE '1995-01-01') <= coalesce(nx - 1, DATE '2001-12-31')""")
def _(t):
    return op.coverage_gaps(order_spans(t), ["code"], "start", "end", "1995-01-01", "2001-12-31")


@query("required_stock_months", "month:s code:i days:s n_days:i",
       """SELECT strftime(o_orderdate, '%Y%m') AS month, o_custkey AS code,
       array_to_string(list_sort(list(DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR))), '|') AS days,
       count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders GROUP BY 1, 2""")
def _(t):
    df = t.orders.select(F.col("o_custkey").alias("code"), "o_orderdate")
    out = op.required_stock_months(df, "o_orderdate", ["code"])
    return out.withColumn("days", F.array_join(F.col("days").cast("array<string>"), "|"))


@query("coerce_numeric", "event_id:i k:r bad:r",
       """SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k,
       CASE WHEN event_type = 'view' THEN NULL ELSE value END AS bad FROM events""")
def _(t):
    bad = F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string"))
    df = t.events.select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"), bad.alias("bad"))
    return op.coerce_numeric(df, ["k", "bad"])


@query("coerce_boolean", "event_id:i flag:b",
       """SELECT event_id, event_type IN ('click', 'view', 'purchase') AS flag FROM events""")
def _(t):
    text = (
        F.when(F.col("event_type") == "click", " TRUE ").when(F.col("event_type") == "view", "1")
        .when(F.col("event_type") == "purchase", "Yes").when(F.col("event_type") == "error", "0")
    )
    return op.coerce_boolean(t.events.select("event_id", text.alias("flag")), ["flag"])


@query("normalize_trade_date", "o_orderkey:i day:d",
       "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(t):
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".0")))
        .otherwise(F.date_format(d, "yyMMdd"))
    )
    return op.normalize_trade_date(t.orders.select("o_orderkey", text.alias("day")), "day")


@query("parse_event_time", "event_id:i clock_time:s",
       """SELECT event_id, CASE event_type WHEN 'click' THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')
       WHEN 'signup' THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS clock_time FROM events""")
def _(t):
    ts = F.col("ts")
    text = (
        F.when(F.col("event_type") == "click", F.date_format(ts, "H:mm"))
        .when(F.col("event_type") == "view", F.date_format(ts, "HHmmss"))
        .when(F.col("event_type") == "error", F.date_format(ts, "yyyyMMddHHmmss"))
        .when(F.col("event_type") == "purchase", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise("0")
    )
    df = t.events.select("event_id", text.alias("clock"), F.to_date("ts").alias("day"))
    out = op.parse_event_time(df, "clock", "day", "at")
    return out.withColumn("clock_time", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


CODE6 = "lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0')"


def six_digit(t):
    n = F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0")
    return t.part.select("p_partkey", n.alias("code"))


@query("board_from_code", "p_partkey:i board:s",
       f"""SELECT p_partkey, CASE WHEN left(c, 3) IN ('600','601','603','605','000','001','002','003') THEN 'main_board'
       WHEN left(c, 3) = '300' THEN 'chinext' WHEN left(c, 3) = '688' THEN 'star' WHEN left(c, 1) IN ('4','8','9') THEN 'bse'
       ELSE 'other' END AS board FROM (SELECT p_partkey, {CODE6} AS c FROM part)""")
def _(t):
    return op.board_from_code(six_digit(t), "code")


@query("valid_code_filter", "p_partkey:i code:s",
       f"SELECT p_partkey, {CODE6} AS code FROM part WHERE regexp_matches({CODE6}, '^[0369]')")
def _(t):
    return op.valid_code_filter(six_digit(t), "code", "^[0369]")


@query("valid_code_excluded", "rows:i excluded:i",
       f"SELECT count(*) AS rows, count(*) FILTER (WHERE NOT regexp_matches({CODE6}, '^[0369]')) AS excluded FROM part")
def _(t):
    return op.excluded_code_count(six_digit(t), "code", "^[0369]")


@query("session_filter", "event_id:i user_id:i",
       """SELECT event_id, user_id FROM events WHERE strftime(ts, '%H:%M') BETWEEN '09:30' AND '11:30'
       OR strftime(ts, '%H:%M') BETWEEN '13:00' AND '15:00'""")
def _(t):
    return op.session_filter(t.events, "ts")


@query("observation_slots", "event_id:i obs:s",
       """SELECT event_id, strftime(date_trunc('minute', ts) + (k * 5) * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') AS obs
       FROM events, unnest(range(-6, 2)) AS u(k)""")
def _(t):
    df = t.events.select("event_id", F.date_trunc("minute", "ts").alias("at"))
    out = op.observation_slots(df, "at")
    return out.withColumn("obs", F.date_format("obs_ts", "yyyy-MM-dd HH:mm"))


ELIGIBLE = {
    "price_floor": ("price", ">=", 950.0), "price_ceiling": ("price", "<=", 1800.0), "seasoned": ("listing_days", ">=", 200),
    "traded_before": ("prev_20d_amount", ">=", 200000.0), "traded_now": ("slot_amount", ">=", 20000.0), "room_for_order": ("entry_room", ">=", 3000.0),
    "below_ceiling": ("dist_up", ">=", 0.5), "above_floor": ("dist_down", ">=", 0.5), "adjusted": ("adj", ">", 0.0),
}


@query("execution_eligibility", "day:d slot:s code:i execution_eligible:b",
       """SELECT day, slot, code, coalesce(price BETWEEN 950 AND 1800 AND day - DATE '1995-01-01' >= 200 AND slot_amount * 3 >= 200000
       AND slot_amount >= 20000 AND slot_amount * 0.1::DOUBLE >= 3000 AND dist_up >= 0.5 AND dist_down >= 0.5
       AND NOT (region = 3) AND adj > 0, false) AS execution_eligible FROM panel""")
def _(t):
    df = op.listing_age_days(t.panel, "day", F.to_date(F.lit("1995-01-01")))
    df = df.withColumns({"is_st": F.col("region") == 3, "prev_20d_amount": F.col("slot_amount") * 3, "entry_room": F.col("slot_amount") * 0.1})
    return op.execution_eligibility(df, ELIGIBLE, ["is_st"])


@query("freshness_gate", "event_id:i fresh:b fresh_or_null:b",
       """SELECT event_id, coalesce(a BETWEEN -60 AND 600, false) AS fresh, a IS NULL OR a BETWEEN -60 AND 600 AS fresh_or_null
       FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN second(ts) * 30 - 120 END AS a FROM events)""")
def _(t):
    age = F.when(F.col("event_type") != "view", F.second("ts") * 30 - 120)
    df = op.freshness_gate(t.events.withColumn("age", age), "age")
    return op.freshness_gate(df, "age", null_ok=True, out="fresh_or_null")


@query("slot_to_minute", "day:d slot:s code:i slot_minute:i",
       "SELECT day, slot, code, CAST(left(slot, 2) AS INT) * 60 + CAST(right(slot, 2) AS INT) - 860 AS slot_minute FROM slot_bars")
def _(t):
    return op.slot_to_minute(t.slot_bars)


@query("listing_age_days", "code:i day:d listing_days:i",
       """SELECT code, day, day - first AS listing_days FROM bars JOIN (SELECT code, min(day) AS first FROM bars GROUP BY code) USING (code)""")
def _(t):
    first = t.bars.groupBy("code").agg(F.min("day").alias("first"))
    return op.listing_age_days(t.bars.join(first, "code"), "day", "first")


@query("labelled_rows", "day:d slot:s code:i t1_close:r",
       "SELECT day, slot, code, t1_close FROM panel WHERE t1_close IS NOT NULL AND ret IS NOT NULL")
def _(t):
    return op.labelled_rows(t.panel, ["t1_close", "ret"])
