"""Queries for the data-quality contracts."""

from pyspark.sql import functions as F

from ..operators import quality as op
from .q_features import loo_sql
from .q_features import op as feat
from .registry import query

CS = ["day", "slot"]


@query("assert_unique", "duplicates:i examples:s",
       """WITH d AS (SELECT l_orderkey || '|' || l_linenumber AS t FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
       SELECT (SELECT count(*) FROM d) AS duplicates, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT t FROM d ORDER BY t LIMIT 5)) AS examples""")
def _(t):
    return op.assert_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("assert_outcome_blind", "day:d slot:s code:i ret:r gap:r", "SELECT day, slot, code, ret, gap FROM panel")
def _(t):
    df = t.panel.select("day", "slot", "code", "ret", "gap")
    op.assert_outcome_blind(df)
    return df


@query("assert_causal", "code:i rows:i violations:i missing:i",
       "SELECT b.code, count(*) AS rows, count(*) FILTER (WHERE m.valid_from > b.day) AS violations, count(*) FILTER (WHERE m.valid_from IS NULL) AS missing FROM bars b LEFT JOIN membership m ON m.code = b.code GROUP BY b.code")
def _(t):
    return op.assert_causal(t.bars.join(t.membership, "code", "left"), "valid_from", "day", by=["code"])


@query("universe_coverage", "day:d expected:i observed:i coverage:r passed:b",
       """SELECT day, count(*) AS expected, count(s.code) AS observed, count(s.code) / count(*)::DOUBLE AS coverage, count(s.code) / count(*)::DOUBLE >= 0.8 AS passed FROM bars b LEFT JOIN
       (SELECT DISTINCT day, code FROM slot_bars) s USING (day, code) GROUP BY day""")
def _(t):
    return op.universe_coverage(t.slot_bars, t.bars, "day", "code", 0.8)


@query("snapshot_gap_list", "code:i day:d snapshots:i",
       "SELECT code, day, coalesce(n, 0) AS snapshots FROM (SELECT code, day FROM bars WHERE amount > 100000) LEFT JOIN (SELECT code, day, count(*) AS n FROM mbars WHERE amount > 30000 GROUP BY ALL) USING (code, day) WHERE coalesce(n, 0) < 4")
def _(t):
    return op.snapshot_gap_list(t.mbars.filter("amount > 30000"), t.bars.filter("amount > 100000"), ["code", "day"], 4)


@query("feature_coverage", "feature:s coverage:r passed:b",
       " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(({e})::INT) AS coverage, avg(({e})::INT) >= 0.99 AS passed FROM panel" for f, e in
                         (("ret", "ret IS NOT NULL"), ("t1_close", "t1_close IS NOT NULL"), ("gap", "gap IS NOT NULL"), ("complete_rows", "ret IS NOT NULL AND t1_close IS NOT NULL AND gap IS NOT NULL"))))
def _(t):
    return op.feature_coverage(t.panel, ["ret", "t1_close", "gap"], 0.99)


@query("coverage_breakdown", "year:i rows:i complete:i no_peers:i shallow:i other_missing:i median_peers:r q10_peers:r complete_rate:r",
       f"""SELECT year(day) AS year, count(*) AS rows, count(*) FILTER (WHERE ok) AS complete, count(*) FILTER (WHERE peer_count = 0) AS no_peers, count(*) FILTER (WHERE peer_count BETWEEN 1 AND 2) AS shallow, count(*) FILTER (WHERE peer_count >= 3 AND NOT ok) AS other_missing,
       median(peer_count) AS median_peers, quantile_cont(peer_count, 0.1) AS q10_peers, avg(ok::INT) AS complete_rate FROM (SELECT *, peer_return_median IS NOT NULL AND peer_own_excess IS NOT NULL AS ok FROM ({loo_sql('nation')})) GROUP BY 1""")
def _(t):
    df = feat.loo_peer_features(t.panel, t.panel.filter("t1_close is not null"), CS, "nation", "code", tail="ret_open", amount="slot_amount")
    return op.coverage_breakdown(df.withColumn("year", F.year("day")), ["year"], "peer_count", 3, ["peer_return_median", "peer_own_excess"])


@query("activity_coverage", "flag:s row_rate:r day_rate:r",
       "WITH d AS (SELECT day, count(*) AS n, sum((p > 0.9)::INT) AS a, sum((q > 0.97)::INT) AS b FROM scored GROUP BY day) SELECT 'a' AS flag, sum(a) / sum(n)::DOUBLE AS row_rate, avg((a > 0)::INT) AS day_rate FROM d UNION ALL SELECT 'b', sum(b) / sum(n)::DOUBLE, avg((b > 0)::INT) FROM d")
def _(t):
    df = t.scored.withColumns({"a": (F.col("p") > 0.9).cast("int"), "b": (F.col("q") > 0.97).cast("int")})
    return op.activity_coverage(df, "day", ["a", "b"])


@query("feature_parity", "feature:s common:i mismatches:i max_abs_diff:r only_left:i only_right:i",
       """WITH j AS (SELECT b.code AS l, s.code AS r, b.close AS bc, s.close AS sc, b.vol AS bv, s.vol AS sv FROM bars b FULL JOIN (SELECT * FROM slot_bars WHERE slot = '14:50') s ON s.code = b.code AND s.day = b.day)
       SELECT 'close' AS feature, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS common, count(*) FILTER (WHERE abs(bc - sc) > 1e-9) AS mismatches, max(abs(bc - sc)) AS max_abs_diff, count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right FROM j
       UNION ALL SELECT 'vol', count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL), count(*) FILTER (WHERE abs(bv - sv) > 1e-9), max(abs(bv - sv)), count(*) FILTER (WHERE r IS NULL), count(*) FILTER (WHERE l IS NULL) FROM j""")
def _(t):
    return op.feature_parity(t.bars, t.slot_bars.filter("slot = '14:50'"), ["code", "day"], ["close", "vol"])


@query("feature_diversity", "feature:s distinct_values:i diverse:b",
       " UNION ALL ".join(f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS distinct_values, count(DISTINCT {f}) >= 10 AS diverse FROM panel" for f in ("slot", "region", "vol", "price")))
def _(t):
    return op.feature_diversity(t.panel, ["slot", "region", "vol", "price"])


@query("tape_audit", "tag:s rows:i bad_codes:i wrong_day:i parse_rate:r disordered:i duplicates:i",
       """SELECT * FROM (SELECT tag, count(*) AS rows, count(*) FILTER (WHERE NOT regexp_matches(CAST(code AS VARCHAR), '^[1-9]')) AS bad_codes, count(*) FILTER (WHERE day <> CAST(ts + INTERVAL 30 MINUTE AS DATE)) AS wrong_day, 1.0::DOUBLE AS parse_rate, count(*) FILTER (WHERE NOT hour(ts) >= 1) AS disordered FROM tape GROUP BY tag)
       JOIN (SELECT tag, sum(n - 1) AS duplicates FROM (SELECT tag, code, day, count(*) AS n FROM tape GROUP BY ALL) GROUP BY tag) USING (tag)""")
def _(t):
    shifted = F.to_date(F.col("ts") + F.expr("interval 30 minutes"))
    return op.tape_audit(t.tape, ["tag"], "day", "code", "ts", ["code", "day"], "^[1-9]", shifted, F.hour("ts") >= 1)


@query("ohlc_consistency", "code:i rows:i missing:i high_violations:i low_violations:i",
       "SELECT code, count(*) AS rows, 0 AS missing, count(*) FILTER (WHERE close > open AND CAST(vol AS BIGINT) % 7 = 0) AS high_violations, 0 AS low_violations FROM bars GROUP BY code")
def _(t):
    # swap high for open on every seventh volume to have something to find
    bad = F.when(F.col("vol").cast("bigint") % 7 == 0, F.col("open")).otherwise(F.col("high"))
    df = t.bars.withColumn("low", F.least("low", "open")).withColumn("low", F.when(F.col("vol").cast("bigint") % 7 == 0, F.least("open", "close")).otherwise(F.col("low")))
    return op.ohlc_consistency(df.withColumn("high", bad), ["code"])


@query("cross_section_probe", "day:d rows:i duplicates:i required_present:i numeric_coverage:r passed:b",
       """SELECT day, sum(n) AS rows, sum(n - 1) AS duplicates, count(*) FILTER (WHERE code IN (1, 2, 3)) AS required_present, least(sum(kr) / sum(n)::DOUBLE, sum(kt) / sum(n)::DOUBLE) AS numeric_coverage,
       sum(n) >= 50 AND sum(n - 1) = 0 AND count(*) FILTER (WHERE code IN (1, 2, 3)) = 3 AS passed FROM (SELECT day, code, count(*) AS n, count(ret) AS kr, count(t1_close) AS kt FROM panel GROUP BY ALL) GROUP BY day""")
def _(t):
    return op.cross_section_probe(t.panel, "day", "code", [1, 2, 3], ["ret", "t1_close"], 50)


@query("stock_slot_audit", "day:d slot:s rows:i codes:i ret_coverage:r nation_large_groups:i region_large_groups:i",
       """SELECT * FROM (SELECT day, slot, count(*) AS rows, count(DISTINCT code) AS codes, avg((ret IS NOT NULL)::INT) AS ret_coverage FROM panel GROUP BY ALL)
       JOIN (SELECT day, slot, count(*) FILTER (WHERE n >= 4) AS nation_large_groups FROM (SELECT day, slot, nation, count(DISTINCT code) AS n FROM panel GROUP BY ALL) GROUP BY ALL) USING (day, slot)
       JOIN (SELECT day, slot, count(*) FILTER (WHERE n >= 4) AS region_large_groups FROM (SELECT day, slot, region, count(DISTINCT code) AS n FROM panel GROUP BY ALL) GROUP BY ALL) USING (day, slot)""")
def _(t):
    return op.stock_slot_audit(t.panel, CS, "code", ["nation", "region"], ["ret"], 4)


@query("mapping_exactness", "expected:i mapped:i missing:i unexpected:i ambiguous:i",
       """WITH h AS (SELECT day, slot, count(*) AS n FROM slot_bars GROUP BY ALL), w AS (SELECT DISTINCT day, s FROM bars, (VALUES ('14:00'), ('14:20'), ('14:35')) v(s)), b AS (SELECT w.s, h.n FROM w FULL JOIN h ON h.day = w.day AND h.slot = w.s)
       SELECT count(s) AS expected, count(n) AS mapped, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE s IS NULL) AS unexpected, count(*) FILTER (WHERE n > 1) AS ambiguous FROM b""")
def _(t):
    return op.mapping_exactness(t.slot_bars, t.bars, ["14:00", "14:20", "14:35"], "day", "slot")


@query("outcome_consistency", "slot:s rows:i availability_mismatch:i label_mismatch:i",
       "SELECT slot, count(*) AS rows, count(*) FILTER (WHERE u < 0.01) AS availability_mismatch, count(*) FILTER (WHERE u >= 0.01 AND (net > 1) <> (net > 0)) AS label_mismatch FROM scored GROUP BY slot")
def _(t):
    df = t.scored.withColumn("y", F.when(F.col("u") >= 0.01, (F.col("net") > 1).cast("int")))
    return op.outcome_consistency(df, "net", "y", ["slot"])


LEDGER = """SELECT day, code, CASE WHEN p > 0.9 THEN 'QUALIFIED' ELSE 'OBSERVATION' END AS cohort, CASE WHEN NOT entry_ok THEN 'NON_FILL' WHEN risk > 0.9 THEN 'PENDING' ELSE 'SETTLED' END AS status,
  CASE WHEN u < 0.95 AND (entry_ok OR q > 0.9) THEN price END AS entry_price FROM scored"""


@query("ledger_invariants", "rule:s violations:i",
       f"""WITH l AS ({LEDGER}), k AS (SELECT day, code, count(*) AS n, count(DISTINCT cohort) AS c FROM l GROUP BY ALL)
       SELECT 'cohorts_overlap' AS rule, count(*) FILTER (WHERE c > 1) AS violations FROM k UNION ALL SELECT 'duplicate_candidate', count(*) FILTER (WHERE n > c) FROM k
       UNION ALL SELECT 'settled_without_price', count(*) FILTER (WHERE status = 'SETTLED' AND entry_price IS NULL) FROM l UNION ALL SELECT 'non_fill_with_price', count(*) FILTER (WHERE status = 'NON_FILL' AND entry_price IS NOT NULL) FROM l
       UNION ALL SELECT 'unknown_status', 0 UNION ALL SELECT 'count_mismatch', count(*) FROM (SELECT day, count(*) AS n, count(*) FILTER (WHERE status <> 'PENDING') AS d FROM l GROUP BY day) WHERE n <> d""")
def _(t):
    status = F.when(~F.col("entry_ok"), "NON_FILL").when(F.col("risk") > 0.9, "PENDING").otherwise("SETTLED")
    ledger = t.scored.select(
        "day", "code", F.when(F.col("p") > 0.9, "QUALIFIED").otherwise("OBSERVATION").alias("cohort"), status.alias("status"),
        F.when((F.col("u") < 0.95) & (F.col("entry_ok") | (F.col("q") > 0.9)), F.col("price")).alias("entry_price"))
    declared = ledger.groupBy("day").agg(F.count(F.when(F.col("status") != "PENDING", 1)).alias("candidates"))
    return op.ledger_invariants(ledger, "day", "code", declared=declared)


@query("table_digest", "l_returnflag:s rows:i digest:i",
       """SELECT l_returnflag, count(*) AS rows, sum(CAST('0x' || substr(md5(concat_ws('|', CAST(l_linenumber AS VARCHAR), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), coalesce(l_returnflag, '\\N'))), 1, 15) AS BIGINT)::HUGEINT) % 2305843009213693951 AS digest FROM lineitem GROUP BY 1""")
def _(t):
    return op.table_digest(t.lineitem, ["l_returnflag"], ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])


@query("shard_completeness", "fold:i declared_rows:i actual_rows:i status:s",
       """WITH a AS (SELECT fold, count(*) AS n, min(day) AS lo, max(day) AS hi FROM scored WHERE p > 0.001 AND fold <> 3 GROUP BY fold), m AS (SELECT fold, count(*) AS n, min(day) AS lo, max(day) AS hi FROM scored WHERE fold <> 5 GROUP BY fold)
       SELECT coalesce(a.fold, m.fold) AS fold, m.n AS declared_rows, a.n AS actual_rows, CASE WHEN a.n IS NULL THEN 'missing' WHEN m.n IS NULL THEN 'unexpected' WHEN a.n = m.n AND a.lo = m.lo AND a.hi = m.hi THEN 'complete' ELSE 'mismatch' END AS status FROM a FULL JOIN m ON a.fold = m.fold""")
def _(t):
    manifest = t.scored.filter("fold <> 5").groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return op.shard_completeness(t.scored.filter("p > 0.001 and fold <> 3"), manifest, "fold", "day")


@query("evaluation_window", "day:d code:i close:r", "SELECT day, code, close FROM bars WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-01'")
def _(t):
    return op.evaluation_window(t.bars, "day", "1996-01-01", "1998-12-01")


@query("calendar_depth", "available_days:i required_days:i sufficient:b",
       "SELECT count(*) FILTER (WHERE day < DATE '1998-01-01') AS available_days, 24 AS required_days, count(*) FILTER (WHERE day < DATE '1998-01-01') >= 24 AS sufficient FROM calendar")
def _(t):
    return op.calendar_depth(t.calendar, "1998-01-01", 24)
