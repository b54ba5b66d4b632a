"""Queries over cohorts, matrices, profiles and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.functions import stats, text
from evimine.operators import audit, cohort, folds, items, packed, prep, profile, ranks, screening
from evimine.plans.facts import BOUNDS, FACTS_SQL, NUMBERS, ROW_KEY, facts, lines, read
from evimine.sources.scratch import FINE, stored


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _line(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def _order() -> list[Column]:
    return [F.col(c) for c in ROW_KEY[2:]]


FIRST_SQL = ", ".join(ROW_KEY[2:])
WITH = f"WITH {FACTS_SQL}"


def _steps() -> list[tuple[str, Column]]:
    return [("priced", F.col("price") > 2000), ("observed discount", F.col("disc") != 0),
        ("keyword", text.contains_any(F.col("p_type"), ("PROMO", "STANDARD", "LARGE"))),
        ("recent", F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"))]


def flow_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.flow(facts(spark, sf_dir), _steps())


_C = ["price > 2000", "disc <> 0", "regexp_matches(p_type, 'PROMO|STANDARD|LARGE')", "l_shipdate >= TIMESTAMP '1996-01-01'"]
_N = ["priced", "observed discount", "keyword", "recent"]
FLOW_AUDIT = f"{WITH} " + " UNION ALL ".join(
    f"SELECT {i + 1} AS step, '{n}' AS name, count(*) FILTER (WHERE {' AND '.join(f'({c})' for c in _C[:i]) or 'true'}) AS n_before, count(*) FILTER (WHERE {' AND '.join(f'({c})' for c in _C[: i + 1])}) AS n_after FROM facts" for i,
        n in enumerate(_N)
)


def stage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(spark, sf_dir)
    first = cohort.keep_first(line, ["l_orderkey", "l_linenumber"], _order())
    return cohort.key_audit([("raw", line), ("first per key", first)], ["l_orderkey", "l_linenumber"])


STAGE_AUDIT = f"""WITH first AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {FIRST_SQL}) = 1)
SELECT 'raw' AS stage, count(*) AS n_rows, 11::BIGINT AS n_columns, count(DISTINCT l_orderkey) AS n_keys_1, count(DISTINCT (l_orderkey,
  l_linenumber)) AS n_keys_2 FROM lineitem
UNION ALL SELECT 'first per key', count(*), 11::BIGINT, count(DISTINCT l_orderkey), count(DISTINCT (l_orderkey, l_linenumber)) FROM first"""


def _sparse(spark, sf_dir) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    line = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return orders.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def missingness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.missingness(_sparse(spark, sf_dir), ["o_orderstatus", "l_linenumber", "l_quantity", "l_tax", "l_discount"])
    return found.withColumn("missing_rate", r6("missing_rate"))


MISSINGNESS_PROFILE = "WITH s AS (SELECT o_orderstatus, l_linenumber, l_quantity, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_rate, count(DISTINCT {c}) AS n_distinct FROM s" for c in ("o_orderstatus",
        "l_linenumber", "l_quantity", "l_tax", "l_discount")
)


def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.duplicate_keys(_line(spark, sf_dir), ["l_orderkey", "l_linenumber"])


DUP_SUMMARY = "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def dedupe_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(spark, sf_dir).select(*ROW_KEY, F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.nullif("l_discount", F.lit(0.0)).alias("disc"))
    return cohort.keep_most_complete(line, ["l_orderkey", "l_linenumber"], _order()).drop("l_shipdate")


DEDUPE_COMPLETE = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, nullif(l_tax, 0) AS tax, nullif(l_discount,
  0) AS disc FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_tax <> 0 AS INTEGER) + CAST(l_discount <> 0 AS INTEGER) DESC, {FIRST_SQL}) = 1"""


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.keep_first(_line(spark, sf_dir).select(*ROW_KEY), ["l_orderkey"], [F.col("l_linenumber"), *_order()]).drop("l_shipdate")


FIRST_PER_KEY = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {FIRST_SQL}) = 1"""


def _parties(spark, sf_dir) -> DataFrame:
    """Parties of an order as they are listed: several times, and in two roles."""
    vulnerable = F.col("l_returnflag") == "R"
    return _line(spark, sf_dir).select(F.col("l_orderkey").alias("acc"), F.col("l_suppkey").alias("party"), vulnerable.alias("flag"), F.col("l_quantity").alias("qty"))


def _counterparts(spark, sf_dir) -> DataFrame:
    order = [F.col("party").cast("string"), F.desc("flag"), F.desc("qty")]
    return cohort.counterpart(_parties(spark, sf_dir), "acc", "party", F.col("flag"), order).drop("other_flag")


PRIORITY_SQL = "CASE WHEN {a} AND NOT {b} THEN 0 WHEN NOT {a} AND {b} THEN 1 ELSE 2 END"
PARTIES_SQL = f"""parties AS (SELECT l_orderkey AS acc, l_suppkey AS party, l_returnflag = 'R' AS flag, max(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3),
best AS (SELECT a.acc, a.party, a.flag AS vulnerable, b.party AS other_party, b.qty AS other_qty, b.flag AS other_vulnerable FROM parties a
  JOIN parties b ON a.acc = b.acc AND a.party <> b.party
         QUALIFY row_number() OVER (PARTITION BY a.acc, a.party ORDER BY {PRIORITY_SQL.format(a="a.flag", b="b.flag")}, b.party::VARCHAR, b.flag DESC) = 1)"""


def counterparty_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counterparts(spark, sf_dir)


COUNTERPARTY_FALLBACK = f"WITH {PARTIES_SQL} SELECT * FROM best"


def _recorded(spark, sf_dir) -> DataFrame:
    """Records whose text names another party, nobody, or the party itself."""
    line, said = _line(spark, sf_dir), F.concat(F.lit("No. "), (F.col("l_partkey") % 100).cast("string"), F.lit(" (x)"))
    opponent = F.when(F.col("l_linenumber") == 1, None).when(F.col("l_quantity") > 45, F.concat(F.col("l_suppkey").cast("string"), F.lit(" itself"))).otherwise(said)
    second = F.when(F.col("l_tax") != 0, F.concat((F.col("l_linenumber") % 3).cast("string"), F.lit("-b")))
    records = line.select(F.col("l_orderkey").alias("acc"), F.col("l_suppkey").alias("party"), opponent.alias("opponent"),
        (F.col("l_linenumber") % 2).cast("string").alias("first"), second.alias("second"))
    return cohort.recorded_counterpart(records, _parties(spark, sf_dir), "acc", "party", F.col("opponent"), [F.col("first"), F.col("second")], F.col("flag"))


def counterparty_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recorded(spark, sf_dir)


RECORDED_SQL = f"""records AS (SELECT l_orderkey AS acc, l_suppkey AS party,
  CASE WHEN l_linenumber = 1 THEN NULL WHEN l_quantity > 45 THEN l_suppkey::VARCHAR ELSE (l_partkey % 100)::VARCHAR END AS other_party,
  l_linenumber % 2 AS n0, CASE WHEN l_tax <> 0 THEN l_linenumber % 3 ELSE 9999 END AS n1 FROM lineitem),
recorded AS (SELECT r.acc, r.party, a.flag AS vulnerable, r.other_party, b.flag AS other_vulnerable FROM records r LEFT
  JOIN parties a ON a.acc = r.acc AND a.party = r.party
  LEFT JOIN parties b ON b.acc = r.acc AND b.party::VARCHAR = r.other_party WHERE r.other_party <> '0' AND r.other_party <> r.party::VARCHAR
  QUALIFY row_number() OVER (PARTITION BY r.acc, r.party ORDER BY {PRIORITY_SQL.format(a="coalesce(a.flag, false)", b="coalesce(b.flag, false)")},
  n0, n1, r.other_party, a.flag DESC NULLS LAST, b.flag DESC NULLS LAST) = 1)"""
COUNTERPARTY_RECORDED = f"WITH {PARTIES_SQL}, {RECORDED_SQL} SELECT * FROM recorded"


def counterparty_exact_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _counterparts(spark, sf_dir).withColumn("other_party", F.col("other_party").cast("string"))
    return cohort.overlay(base, _recorded(spark, sf_dir), ["acc", "party"], ["other_party", "other_vulnerable"])


COUNTERPARTY_EXACT_OVERLAY = f"""WITH {PARTIES_SQL}, {RECORDED_SQL}
SELECT acc, party, best.vulnerable, coalesce(recorded.other_party, best.other_party::VARCHAR) AS other_party, other_qty,
  coalesce(recorded.other_vulnerable, best.other_vulnerable) AS other_vulnerable FROM best LEFT JOIN recorded USING (acc, party)"""


def opponent_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = cohort.prefixed(read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "other_party"), "OPP_", ["other_party"])
    return cohort.left_biased(_counterparts(spark, sf_dir), supplier, ["other_party"])


OPPONENT_DIM_JOIN = f"WITH {PARTIES_SQL} SELECT b.*, s_name AS OPP_s_name, s_nationkey AS OPP_s_nationkey, s_acctbal AS OPP_s_acctbal FROM best b LEFT JOIN supplier ON s_suppkey = other_party"


def two_tier_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(spark, sf_dir)
    fine = line.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("best_qty"))
    coarse = line.where("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.max("l_quantity").alias("best_qty"))
    base = line.select("l_orderkey", "l_suppkey").distinct()
    return cohort.two_tier(base, fine, ["l_orderkey", "l_suppkey"], coarse, ["l_suppkey"], ["best_qty"])


TWO_TIER_FILL = """WITH fine AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
  coarse AS (SELECT l_suppkey, max(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_orderkey, l_suppkey, coalesce(a, b) AS best_qty FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) LEFT JOIN fine USING (l_orderkey,
  l_suppkey) LEFT JOIN coarse USING (l_suppkey)"""


def left_biased_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment",
        F.lit("taken from the right").alias("o_orderstatus"), "c_nationkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    joined = cohort.left_biased(cohort.left_biased(orders, customer, ["o_custkey"]), nation, ["c_nationkey"])
    return cohort.join_by_available(joined, read(spark, sf_dir, "region"), ["c_nationkey", "r_regionkey"], [F.col("r_name")])


LEFT_BIASED_JOIN = """SELECT o_orderkey, o_custkey, o_orderstatus, c_mktsegment, c_nationkey, n_name, n_regionkey AS r_regionkey, r_name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _line(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"))
    sides = [orders.join(line, "o_orderkey", how).groupBy("o_orderstatus").agg(F.lit(how).alias("side"),
        F.count(F.lit(1)).alias("n")) for how in ("left_semi", "left_anti")]
    return sides[0].unionByName(sides[1])


SEMI_ANTI = """SELECT o_orderstatus, 'left_semi' AS side, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
UNION ALL SELECT o_orderstatus, 'left_anti', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"""


def sentinel_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    raw = f.select("split", F.col("tax").cast("string").alias("tax"), F.col("disc").cast("string").alias("disc"),
        F.when(F.col("qty") > 45, "99-未知").otherwise(F.col("qty").cast("string")).alias("qty"))
    codes = {"tax": (0.0,), "disc": (0.0,), "qty": ()}
    long = raw.select("split",
        F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), text.sentinel(F.col(c), v).alias("s"), text.observed_number(F.col(c), v).alias("v")) for c, v in codes.items()))).alias("x")).select("split",
        "x.*")
    return long.groupBy("split", "feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("s").alias("n_sentinel"),
        r6(F.count_if("s") / F.count(F.lit(1))).alias("sentinel_rate"), F.count_if(F.col("v").isNull()).alias("n_missing_after"))


SENTINEL_FLAGS = f"{WITH} " + " UNION ALL ".join(f"SELECT split, '{c}' AS feature, count(*) AS n_rows, count(*) FILTER (WHERE {w}) AS n_sentinel, round(count(*) FILTER (WHERE {w}) / count(*)::DOUBLE, 6) AS sentinel_rate, count(*) FILTER (WHERE {w}) AS n_missing_after FROM facts GROUP BY split" for c,
    w in (("tax", "tax = 0"), ("disc", "disc = 0"), ("qty", "qty > 45")))


def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", text.first_number(F.col("p_brand")).alias("brand_no"), text.digits(F.col("p_brand")).alias("brand_digits"),
        text.code_digit(F.col("p_brand")).alias("code"), text.normalize_key(F.col("p_size").cast("double")).alias("size_key"),
        text.sanitized(F.concat(F.col("p_name"), F.lit(" (x)"))).alias("clean_name"))


FIRST_NUMBER = r"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '(-?\d+\.?\d*)', 1), '') AS DOUBLE) AS brand_no,
  nullif(regexp_extract(p_brand, '(\d+)', 1), '') AS brand_digits,
CAST(nullif(nullif(regexp_extract(p_brand, '(\d)', 1), ''), '9') AS INTEGER) AS code, p_size::VARCHAR AS size_key, replace(p_name, ' ',
  '_') || '_x' AS clean_name FROM part"""


def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    energy = F.when(F.col("p_type") == "PROMO", "petrol hybrid").when(F.col("p_type") == "LARGE", "battery electric").when(F.col("p_type") == "SMALL", "diesel")
    return part.select("p_partkey", text.contains_any(F.col("p_name"), ("ring", "bolt")).alias("is_fastener"), *(c.alias(n) for n, c in text.powertrain(energy).items()))


KEYWORD_FLAGS = "SELECT p_partkey, regexp_matches(p_name, 'ring|bolt') AS is_fastener, " + ", ".join(f"CASE WHEN p_type IN ('PROMO', 'LARGE', 'SMALL') THEN CAST(p_type = '{t}' AS INTEGER) ELSE 0 END AS {n}" for n,
    t in (("electric", "LARGE"), ("hybrid", "PROMO"), ("fuel_only", "SMALL"))) + " FROM part"


def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "not a time").when(F.col("event_id") % 2 == 0,
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm"))
    return events.select("event_id", *(c.alias(n) for n, c in text.time_parts(text.parsed_time(raw)).items()))


TEMPORAL_FEATURES = """WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts FROM events)
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(coalesce(hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19, false) AS INTEGER) AS rush_hour,
CAST(coalesce(hour(ts) >= 19 OR hour(ts) <= 6, false) AS INTEGER) AS night, CAST(coalesce(isodow(ts) >= 6, false) AS INTEGER) AS weekend FROM t"""


def right_closed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(text.right_closed(F.col("p_size").cast("double"), (-1.0, 18.0, 30.0, 45.0), ("young", "middle", "old")).alias("bin"))
    return part.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


RIGHT_CLOSED_BINS = "SELECT CASE WHEN p_size > -1 AND p_size <= 18 THEN 'young' WHEN p_size <= 30 THEN 'middle' WHEN p_size <= 45 THEN 'old' END AS bin, count(*) AS n FROM part GROUP BY 1"


def coalesce_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    a = text.code_digit(F.concat(F.when(F.col("qty") > 40, "9").otherwise((F.col("qty").cast("int") % 7).cast("string")), F.lit("-code")))
    b = text.code_digit(F.concat((F.col("line") % 5).cast("string"), F.lit("-code")))
    return f.select(F.coalesce(a, b).alias("grade")).groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") >= 3).alias("n_severe"))


COALESCE_LABEL = f"{WITH} SELECT CASE WHEN qty > 40 THEN line % 5 ELSE qty::INTEGER % 7 END AS grade, count(*) AS n, count(*) FILTER (WHERE CASE WHEN qty > 40 THEN line % 5 ELSE qty::INTEGER % 7 END >= 3) AS n_severe FROM facts GROUP BY 1"


def _observed(f: DataFrame) -> DataFrame:
    return f.withColumns({"disc": F.nullif("disc", F.lit(0.0)), "tax": F.nullif("tax", F.lit(0.0))})


def bounded_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _observed(facts(spark, sf_dir))
    train = prep.require_training_only(f.where("split = 'train'"))
    done = prep.transform(f, prep.fit(train, {k: BOUNDS[k] for k in ("qty", "price", "disc")}, []), ["split"])
    return done.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c)).alias(f"{c}_mean") for c in ("qty", "price", "disc")),
        *(F.min(c).alias(f"{c}_low") for c in ("qty", "price", "disc")), *(F.max(c).alias(f"{c}_high") for c in ("qty", "price", "disc")))


def _clip_sql(c: str) -> str:
    lo, hi = BOUNDS[c]
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({lo}::DOUBLE, least({hi}::DOUBLE, {c})) END"


BOUNDED_IMPUTE = f"""{WITH}, o AS (SELECT split, qty, price, nullif(disc, 0) AS disc FROM facts), c AS (SELECT split,
  {", ".join(f"{_clip_sql(c)} AS {c}" for c in ("qty", "price", "disc"))} FROM o),
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in ("qty", "price", "disc"))} FROM c WHERE split = 'train'), x AS (SELECT split,
  {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in ("qty", "price", "disc"))} FROM c, m)
SELECT split, count(*) AS n,
  {", ".join(f"round(avg({c}), 6) AS {c}_mean, min({c}) AS {c}_low, max({c}) AS {c}_high" for c in ("qty", "price", "disc"))} FROM x GROUP BY split"""


def one_hot_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).withColumn("p_type", F.when((F.col("split") == "train") & (F.col("p_type") == "PROMO"), None).otherwise(F.col("p_type")))
    done = prep.transform(f, prep.fit(f.where("split = 'train'"), {}, ["p_type", "o_orderstatus"]), ["split"])
    return done.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in done.columns if c != "split"))


ONE_HOT_ALIGNED = f"{WITH} SELECT split, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {c}_{v}" for c,
    vs in (("p_type", ("ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD")), ("o_orderstatus", "FOP")) for v in vs) + " FROM facts GROUP BY split"


def _long(spark, sf_dir, features=NUMBERS) -> DataFrame:
    return profile.long_form(facts(spark, sf_dir), ["split", "y"], list(features))


LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT split, y, '{c}' AS feature, {c}::DOUBLE AS value FROM facts" for c in NUMBERS) + ")"
BOUNDS_SQL = "bounds(feature, lo, hi) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in BOUNDS.items()) + ")"


def _bounds(spark) -> DataFrame:
    return items.local(spark, [(k, *v) for k, v in BOUNDS.items()], "feature string, lo double, hi double")


def bounds_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bounds_audit(_long(spark, sf_dir), _bounds(spark), ["split"]).drop("extreme")


BOUNDS_AUDIT = f"{WITH}, {LONG_SQL}, {BOUNDS_SQL} SELECT split, feature, count(value) AS n, count(*) FILTER (WHERE value < lo) AS n_below, count(*) FILTER (WHERE value > hi) AS n_above, min(value) AS low, max(value) AS high FROM long JOIN bounds USING (feature) GROUP BY split, feature"


def outlier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bounds_audit(_long(spark, sf_dir), _bounds(spark), []).select("feature", "low", "high", "extreme")


OUTLIER_AUDIT = f"{WITH}, {LONG_SQL}, {BOUNDS_SQL} SELECT feature, min(value) AS low, max(value) AS high, max(CAST(value < lo * 0.5::DOUBLE OR value > hi * 2 AS INTEGER)) AS extreme FROM long JOIN bounds USING (feature) GROUP BY feature"


def zero_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).withColumns({"tax": F.when(F.col("split") == "test", 0.0).otherwise(F.col("tax")), "open": (F.col("l_linestatus") == "O").cast("int")})
    found = profile.zero_collapse(profile.long_form(f, ["split"], ["tax", "disc", "open"]))
    return found.select("feature", r6("train_nonzero").alias("train_nonzero"), r6("test_nonzero").alias("test_nonzero"), "status")


ZERO_COLLAPSE = f"{WITH} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg(CAST({v} <> 0 AS INTEGER)) FILTER (WHERE split = 'train'), 6) AS train_nonzero, round(avg(CAST({v} <> 0 AS INTEGER)) FILTER (WHERE split = 'test'), 6) AS test_nonzero, '{s}' AS status FROM facts"
    for n, v, s in (("tax", "CASE WHEN split = 'test' THEN 0 ELSE tax END", "collapsed"), ("disc", "disc", "ok"), ("open", "CAST(l_linestatus = 'O' AS INTEGER)", "ok"))
)


def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    features = ["qty", "disc", "p_size", "open"]
    values = profile.long_form(stored(f.select("split", *features)), ["split"], features)
    smd = profile.balance(values).select("feature", "binary", r6("smd").alias("smd"))
    s = profile.summary(values.where("split = 'train'"), ["feature"])
    return s.join(smd, "feature").select("feature", "binary", "n", *(r6(c).alias(c) for c in ("mean", "sd", "q1", "median", "q3")), "smd")


BASELINE_TABLE = f"""{WITH},
  v AS ({" UNION ALL ".join(f"SELECT split, '{n}' AS feature, CAST({c} AS DOUBLE) AS value FROM facts" for n, c in (("qty", "qty"), ("disc", "disc"), ("p_size", "p_size"), ("open", "CAST(l_linestatus = 'O' AS INTEGER)")))}),
a AS (SELECT feature, CAST(min(CAST(value IN (0, 1) AS INTEGER)) AS INTEGER) AS "binary", avg(value) FILTER (WHERE split = 'train') AS m1,
  avg(value) FILTER (WHERE split = 'test') AS m2, var_samp(value) FILTER (WHERE split = 'train') AS v1,
  var_samp(value) FILTER (WHERE split = 'test') AS v2 FROM v GROUP BY feature),
s AS (SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, median(value) AS median,
  quantile_cont(value, 0.75) AS q3 FROM v WHERE split = 'train' GROUP BY feature)
SELECT feature, "binary", n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
round(CASE WHEN "binary" = 1 THEN (m1 - m2) / sqrt((m1 * (1 - m1) + m2 * (1 - m2)) / 2) ELSE (m1 - m2) / sqrt((v1 + v2) / 2) END, 6) AS smd FROM s
  JOIN a USING (feature)"""


def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and label rate on both sides of a stratified split that keeps orders whole, and orders on both sides."""
    f = facts(spark, sf_dir).select("grp", "y")
    placed = stored(f.join(folds.assign(f, "grp", "y"), "grp").select("grp", "y", F.when(F.col("fold") == 0, "test").otherwise("train").alias("split")))
    both = placed.groupBy("grp").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_overlap"))
    sides = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("grp").alias("n_groups"), r6(F.avg("y")).alias("label_rate"))
    return sides.crossJoin(both)


FOLDS_SQL = """per_group AS (SELECT grp, count(*)::BIGINT AS n, sum(y)::BIGINT AS y, md5('42:' || grp) AS place FROM facts GROUP BY grp),
shapes AS (SELECT n, y, count(*) AS m, count(*) // 5 AS each, count(*) % 5 AS more, n - y AS neg FROM per_group GROUP BY n, y),
totals AS (SELECT sum(m * neg)::DOUBLE AS tn, sum(m * y)::DOUBLE AS tp, sum(each * neg)::BIGINT AS bn, sum(each * y)::BIGINT AS bp FROM shapes),
rest AS (SELECT n, y, neg, row_number() OVER (ORDER BY abs(neg - y) DESC, n DESC, y DESC, i) AS k FROM shapes, LATERAL (SELECT unnest(range(more)) AS i)),
walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS y, -1::BIGINT AS fold, [bn, bn, bn, bn, bn] AS fn, [bp, bp, bp, bp, bp] AS fp FROM totals
  UNION ALL SELECT k, n, y, pick - 1, list_transform(fn, lambda v, i: v + CASE WHEN i = pick THEN neg ELSE 0 END),
    list_transform(fp, lambda v, i: v + CASE WHEN i = pick THEN y ELSE 0 END)
  FROM (SELECT r.*, w.fn, w.fp, list_position(costs, list_min(costs))::BIGINT AS pick FROM (
      SELECT r.k, list_transform(range(1, 6), lambda i: w.fn[i] * r.neg / (t.tn * t.tn) + w.fp[i] * r.y / (t.tp * t.tp)) AS costs FROM walk w JOIN rest r ON r.k = w.k + 1, totals t) c
    JOIN rest r USING (k) JOIN walk w ON w.k = r.k - 1)),
quota AS (SELECT s.n, s.y, f.fold, s.each + count(w.k) AS q FROM shapes s, (SELECT unnest(range(5)) AS fold) f LEFT JOIN walk w ON w.n = s.n AND w.y = s.y AND w.fold = f.fold AND w.k > 0 GROUP BY s.n, s.y, s.each, f.fold),
ends AS (SELECT n, y, fold, sum(q) OVER (PARTITION BY n, y ORDER BY fold) AS last, sum(q) OVER (PARTITION BY n, y ORDER BY fold) - q AS first FROM quota),
folds AS (SELECT grp, fold FROM (SELECT *, row_number() OVER (PARTITION BY n, y ORDER BY place) AS spot FROM per_group) g JOIN ends e ON e.n = g.n AND e.y = g.y AND spot > first AND spot <= last)"""
SPLIT_AUDIT = f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, {FOLDS_SQL}, placed AS (SELECT grp, facts.y, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split FROM facts JOIN folds USING (grp))
SELECT split, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, round(avg(y), 6) AS label_rate,
  (SELECT count(*) FROM (SELECT grp FROM placed GROUP BY grp HAVING count(DISTINCT split) > 1)) AS n_overlap FROM placed GROUP BY split"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    mixed = f.groupBy("grp").agg(F.count_distinct("split").alias("k"))
    return audit.checks(
        [
            audit.check(mixed, "split_overlap", "no group in both splits", F.max("k") == 1),
            audit.check(f, "label_binary", "label is 0 or 1", text.is_binary_like(F.col("y"))),
            audit.check(f, "quantity_bounds", "quantity within 1 and 50", (F.min("qty") >= 1) & (F.max("qty") <= 50)),
            audit.check(f, "line_key_unique", "order and line name a row", F.count_distinct(F.struct("grp", "line")) == F.count(F.lit(1))),
        ]
    )


CHECKS = f"""{WITH} SELECT 'split_overlap' AS name, 'no group in both splits' AS required, CASE WHEN max(k) = 1 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT count(DISTINCT split) AS k FROM facts GROUP BY grp)
UNION ALL SELECT 'label_binary', 'label is 0 or 1', CASE WHEN count(*) FILTER (WHERE y NOT IN (0, 1)) = 0 THEN 'PASS' ELSE 'FAIL' END FROM facts
UNION ALL SELECT 'quantity_bounds', 'quantity within 1 and 50', CASE WHEN min(qty) >= 1 AND max(qty) <= 50 THEN 'PASS' ELSE 'FAIL' END FROM facts
UNION ALL SELECT 'line_key_unique', 'order and line name a row', CASE WHEN count(DISTINCT (grp, line)) = count(*) THEN 'PASS' ELSE 'FAIL' END FROM facts"""


def redundancy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.redundancy(facts(spark, sf_dir), NUMBERS).withColumn("redundancy", r6("redundancy"))


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
REDUNDANCY_INDEX = f"{WITH} SELECT round(({' + '.join(f'coalesce(abs(corr({a}, {b})), 0)' for a, b in _PAIRS)}) / {len(_PAIRS)}, 6) AS redundancy, {len(_PAIRS)}::BIGINT AS n_pairs FROM facts"


def _signal(spark, sf_dir) -> DataFrame:
    return profile.label_signal(_long(spark, sf_dir).where("split = 'train'"), "y")


def univariate_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir).withColumn("signal", r6("signal"))


SIGNAL_SQL = f"{WITH}, {LONG_SQL}, sig AS (SELECT feature, abs((avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0)) / sqrt((var_samp(value) FILTER (WHERE y = 1) + var_samp(value) FILTER (WHERE y = 0)) / 2)) AS signal FROM long WHERE split = 'train' GROUP BY feature)"
UNIVARIATE_SIGNAL = f"{SIGNAL_SQL} SELECT feature, round(signal, 6) AS signal FROM sig"


def _edges(spark) -> DataFrame:
    return items.local(spark, [(k, [a + (b - a) * i / 8 for i in range(1, 8)]) for k, (a, b) in BOUNDS.items()], "feature string, cuts array<double>")


def _information(spark, sf_dir) -> DataFrame:
    return profile.binned_information(_long(spark, sf_dir).where("split = 'train'"), "y", _edges(spark))


def binned_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir).withColumn("information", F.round("information", 9))


_CUTS = {k: [a + (b - a) * i / 8 for i in range(1, 8)] for k, (a, b) in BOUNDS.items()}
MI_SQL = f"""binned AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, y, {' + '.join(f'CAST({k} > {c!r}::DOUBLE AS INTEGER)' for c in cuts)} AS bin FROM facts WHERE split = 'train'" for k, cuts in _CUTS.items())}),
cells AS (SELECT feature, bin, y, count(*)::DOUBLE AS n FROM binned GROUP BY ALL),
terms AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature,
  bin) * sum(n) OVER (PARTITION BY feature, y))) AS t FROM cells),
mi AS (SELECT feature, sum(t) AS information FROM terms GROUP BY feature)"""
BINNED_MI = f"{WITH}, {MI_SQL} SELECT feature, round(information, 9) AS information FROM mi"


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = _signal(spark, sf_dir).select(F.lit("signal").alias("method"), "feature", F.round("signal",
        12).alias("score")).unionByName(_information(spark, sf_dir).select(F.lit("information").alias("method"), "feature",
        F.round("information", 12).alias("score")))
    found = profile.fuse(rankings, 3)
    return found.select("feature", "votes", *(r6(c).alias(c) for c in ("mean_rank", "mean_points", "mean_norm")))


RANK_FUSION = f"""{SIGNAL_SQL}, {MI_SQL}, u AS (SELECT 'signal' AS method, feature, round(signal, 12) AS score FROM sig
  UNION ALL SELECT 'information', feature, round(information, 12) FROM mi),
k AS (SELECT method, feature, rank() OVER (PARTITION BY method ORDER BY score DESC) AS rk, count(*) OVER (PARTITION BY method) AS n,
  (score - min(score) OVER (PARTITION BY method)) / (max(score) OVER (PARTITION BY method) - min(score) OVER (PARTITION BY method)) AS norm FROM u)
SELECT feature, count(*) FILTER (WHERE rk <= 3) AS votes, round(avg(rk), 6) AS mean_rank, round(avg((n - rk + 1) / n::DOUBLE), 6) AS mean_points,
  round(avg(norm), 6) AS mean_norm FROM k GROUP BY feature"""


def auroc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).select("split", F.col("y").alias("label"), (F.col("qty") / 50.0).alias("score"))
    found = screening.metric_row(f, ("split",))
    return found.select("split", *(r6(c).alias(c) for c in ("auroc", "average_precision", "recall", "precision", "balanced_accuracy", "f_beta")))


METRIC_SQL = """g AS (SELECT {by}, score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (PARTITION BY {by}
  ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g),
ranking AS (SELECT {by}, sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auroc,
  sum(pos * (tp / (tp + fp)::DOUBLE)) / sum(pos) AS average_precision FROM c GROUP BY {by})"""
AUROC_AP = f"""{WITH}, s AS (SELECT split, y AS label, qty / 50.0::DOUBLE AS score FROM facts), {METRIC_SQL.format(by="split")},
cell AS (SELECT split, (count(*) FILTER (WHERE score >= 0.5 AND label = 1))::DOUBLE AS tp, (count(*) FILTER (WHERE score >= 0.5
  AND label = 0))::DOUBLE AS fp, (count(*) FILTER (WHERE score < 0.5 AND label = 1))::DOUBLE AS fn, (count(*) FILTER (WHERE score < 0.5
  AND label = 0))::DOUBLE AS tn FROM s GROUP BY split)
SELECT split, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp),
  6) AS precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
round(3.25::DOUBLE * tp / (3.25::DOUBLE * tp + 2.25::DOUBLE * fn + fp), 6) AS f_beta FROM ranking JOIN cell USING (split)"""


def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).select("grp", F.col("y").alias("label"), (F.col("qty") / 50.0).alias("a"), (F.col("disc") * 10).alias("b"))
    each = f.select("grp", "label", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in "ab"))))
    held = each.withColumn("fold", (F.col("grp") % 10).cast("long"))
    metrics = ranks.ranking_metrics(stats.score_counts(held, "score", "label", ("model", "fold")), "score", ("model", "fold"))
    return screening.holdouts(metrics, ["model"]).select("model", r6("auroc_mean").alias("auroc_mean"), r6("auroc_sd").alias("auroc_sd"), "n")


HOLDOUT_SUMMARY = f"""{WITH}, s AS (SELECT 'a' AS model, grp % 10 AS fold, y AS label, qty / 50.0::DOUBLE AS score FROM facts UNION ALL SELECT 'b',
  grp % 10, y, disc * 10 FROM facts), {METRIC_SQL.format(by="model, fold")}
SELECT model, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_sd, count(*) AS n FROM ranking GROUP BY model"""


def union_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("title"))
    return audit.widened([a, b])


UNION_WIDEN = "SELECT n_nationkey::BIGINT AS key, n_name AS name, NULL::VARCHAR AS title FROM nation UNION ALL SELECT r_regionkey::BIGINT, NULL, r_name FROM region"


def unseen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).withColumn("p_brand",
        F.when((F.col("split") == "train") & (F.col("p_size") > 25), None).otherwise(F.concat("p_brand", F.lit("-"), (F.col("p_size") > 25).cast("string"))))
    return prep.unseen_levels(f.where("split = 'train'"), f.where("split = 'test'"), ["p_brand", "o_orderstatus"])


UNSEEN_LEVELS = f"{WITH}, v AS (SELECT split, CASE WHEN split = 'train' AND p_size > 25 THEN NULL ELSE p_brand || '-' || CAST(p_size > 25 AS VARCHAR) END AS level FROM facts) SELECT DISTINCT 'p_brand' AS feature, level FROM v WHERE split = 'test' AND level IS NOT NULL AND level NOT IN (SELECT level FROM v WHERE split = 'train' AND level IS NOT NULL)"


#: Candidates of the composition: family, meaning, source, and what keeps them back.
CANDIDATES = {
    "qty": ("quantity", "volume", "qty", None, None), "price": ("price", "value", "price", None, None), "disc": ("price", "rebate", "disc", None, None), "p_size": ("part", "size", "p_size", None, None),
    "s_acctbal": ("supplier", "balance", "s_acctbal", None, None), "o_totalprice": ("order", "value", "o_totalprice", None, None), "tax": ("order", "duty", "tax", "partial_unknown_detail", None),
    "line": ("order", "place", "line", "raw", None), "half": ("quantity", "half", "qty", None, None), "size_group": ("part", "size_group", "p_size", None, "p_size"), "unknown": ("other", "unknown", "unknown", "pure_missing_unknown", None),
}
LIMITS = screening.Limits(size=8, family_min={"price": 1, "order": 1}, family_cap={"price": 1, "quantity": 1}, forced=("p_size",))


def _candidates(spark, sf_dir) -> list[dict]:
    f = facts(spark, sf_dir).where("split = 'train'").withColumns({"half": F.col("qty") * F.col("disc"), "size_group": F.floor(F.col("p_size") / 10), "unknown": F.col("disc").isNull().cast("int") + F.col("line") * 0.1})
    rows = profile.label_signal(profile.long_form(f, ["y"], list(CANDIDATES)), "y").collect()
    names = ("family", "semantic", "source", "missing", "alias_of")
    out = [{"feature": r["feature"], "score": r["signal"], **dict(zip(names, CANDIDATES[r["feature"]], strict=True))} for r in rows]
    return [c | {"raw": c["missing"] == "raw"} for c in out]


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features chosen under all rules, in order, from the ranking of training rows."""
    chosen, _ = screening.compose(_candidates(spark, sf_dir), LIMITS)
    return spark.createDataFrame([(i + 1, c["feature"], c["family"], round(float(c["score"]), 6)) for i, c in enumerate(chosen)],
        "place int, feature string, family string, score double")


def _composition_sql() -> str:
    text = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    known = ", ".join(f"('{f}', {', '.join(map(text, v))})" for f, v in CANDIDATES.items())
    signals = " UNION ALL ".join(f"SELECT y, '{c}' AS feature, {e}::DOUBLE AS value FROM facts WHERE split = 'train'" for c, e in {**{c: c for c in CANDIDATES}, "half": "qty * disc", "size_group": "floor(p_size / 10)", "unknown": "(disc IS NULL)::INTEGER + line * 0.1"}.items())
    passes = ["(0, 'forced', 1, 1, 1, 0)", *(f"({i + 1}, '{f}', 0, 0, 0, 0)" for i, f in enumerate(LIMITS.family_min)), "(10, 'all', 0, 0, 0, 0)", "(11, 'all', 1, 0, 0, 0)", "(12, 'all', 1, 1, 0, 0)", "(13, 'all', 1, 1, 1, 0)", "(14, 'all', 1, 1, 1, 1)"]
    caps = "CASE c.family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.family_cap.items()) + f" ELSE {LIMITS.default_cap} END"
    least = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.family_min.items()) + " END"
    count = lambda c: f"len(list_filter(w.{c}, lambda x: x = c.{c}))"
    return f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, v AS ({signals}),
g AS (SELECT feature, abs((avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0)) / sqrt((var_samp(value) FILTER (WHERE y = 1) + var_samp(value) FILTER (WHERE y = 0)) / 2)) AS score FROM v GROUP BY feature),
k(feature, family, semantic, source, missing, alias_of) AS (VALUES {known}),
p(pass, kind, rf, rs, rm, rp) AS (VALUES {", ".join(passes)}),
a AS (SELECT p.*, k.*, score, row_number() OVER (ORDER BY pass, score DESC, feature) AS i FROM p, k JOIN g USING (feature)
  WHERE CASE kind WHEN 'forced' THEN feature IN ({", ".join(map(repr, LIMITS.forced))}{"," if not LIMITS.forced else ""}) WHEN 'all' THEN (rp = 1) = (missing IS NOT DISTINCT FROM 'partial_unknown_detail') ELSE family = kind END),
walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS feature, []::VARCHAR[] AS family, []::VARCHAR[] AS semantic, []::VARCHAR[] AS source
  UNION ALL SELECT i, CASE WHEN ok THEN list_append(fs, f) ELSE fs END, CASE WHEN ok THEN list_append(fams, fam) ELSE fams END, CASE WHEN ok THEN list_append(sems, sem) ELSE sems END, CASE WHEN ok THEN list_append(srcs, src) ELSE srcs END
  FROM (SELECT c.i, w.feature AS fs, w.family AS fams, w.semantic AS sems, w.source AS srcs, c.feature AS f, c.family AS fam, c.semantic AS sem, c.source AS src,
    len(w.feature) < {LIMITS.size} AND NOT list_contains(w.feature, c.feature) AND coalesce(c.missing, '') NOT IN ('raw', 'pure_missing_unknown') AND NOT coalesce(list_contains(w.feature, c.alias_of), false)
    AND (coalesce(c.missing, '') <> 'partial_unknown_detail' OR c.rp = 1) AND (c.rf = 1 OR {count("family")} < {caps}) AND (c.rm = 1 OR {count("semantic")} < 1) AND (c.rs = 1 OR {count("source")} < 1)
    AND coalesce({count("family")} < {least}, true) AS ok FROM walk w JOIN a c ON c.i = w.i + 1)),
done AS (SELECT * FROM walk QUALIFY i = max(i) OVER ())
SELECT place::INTEGER AS place, feature[place] AS feature, family[place] AS family, (SELECT round(score, 6) FROM g WHERE g.feature = done.feature[place]) AS score FROM done, LATERAL (SELECT unnest(range(1, len(feature) + 1)) AS place)"""


COMPOSITION = _composition_sql()


def _facts_with_flag(spark, sf_dir, features) -> DataFrame:
    f = facts(spark, sf_dir).withColumn("flag_n", (F.col("l_returnflag") == "N").cast("int"))
    return f.select("split", "grp", "y", *features)


def _with_flag(spark, sf_dir, features) -> DataFrame:
    """The features, label, group and split of every row, written once: a fit reads them several times, and the tables are joined for one of those only."""
    return stored(_facts_with_flag(spark, sf_dir, features), FINE)


def _lines_with_flag(spark, sf_dir, features) -> DataFrame:
    """The same of the lineitems' own columns, read where they lie."""
    f = lines(spark, sf_dir).withColumn("flag_n", (F.col("l_returnflag") == "N").cast("int"))
    return f.select("split", "grp", "y", *features)


def _model(spark, sf_dir, name) -> DataFrame:
    f = _with_flag(spark, sf_dir, [*NUMBERS, "flag_n"])
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    _, scored = screening.fit_score(train, test, [*NUMBERS, "flag_n"], "y", name, ["grp"])
    return screening.metric_row(scored).withColumn("model", F.lit(name))


def ml_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "logistic")


def ml_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "forest")


def ml_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted anew on ten splits by group, and its mean and spread."""
    features = ["qty", "price", "flag_n"]
    found = screening.repeated_holdouts(_lines_with_flag(spark, sf_dir, features), features, "y", "grp")
    rows = items.local(spark, [(r["model"], r["seed"], r["auroc"]) for r in found], "model string, seed int, auroc double")
    return screening.holdouts(rows, ["model"])


def ml_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of F1 per shuffled feature, and how often a feature is among the first of a sparse linear model."""
    features = ["qty", "price", "disc", "flag_n"]
    f = _lines_with_flag(spark, sf_dir, features)
    rows = screening.folded(f, features, "y", "grp", 3)
    lost = screening.permutation_importance(f, features, "y", "grp", rows=rows)
    first = screening.stability(f, features, "y", "grp", ("lasso",), folds=3, top=2, rows=rows)
    return items.local(spark, [(k, float(v), float(first[k])) for k, v in lost.items()], "feature string, lost_f1 double, stability double")


def ml_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models on the first features of the univariate ranking."""
    f = _facts_with_flag(spark, sf_dir, [*NUMBERS, "flag_n"])
    rows = packed.rows(f, [*NUMBERS, "flag_n"], "y", [F.col("split") == "train"])
    signal = dict(zip(rows.features, rows.scale.signal[0].tolist(), strict=True))
    ranked = sorted(NUMBERS, key=lambda c: (-signal[c] if signal[c] == signal[c] else 1.0, c)) + ["flag_n"]
    found = screening.feature_sweep(f.where("split = 'train'"), f.where("split = 'test'"), ranked, "y", (3, 7), ("logistic", "boosted"), rows)
    return items.local(spark, [(r["n_features"], r["model"], r["auroc"], r["average_precision"]) for r in found],
        "n_features int, model string, auroc double, average_precision double")


NAMES = (
    "flow_audit stage_audit missingness_profile dup_summary dedupe_complete first_per_key counterparty_fallback counterparty_recorded counterparty_exact_overlay opponent_dim_join two_tier_fill left_biased_join semi_anti "
    "sentinel_flags first_number keyword_flags temporal_features right_closed_bins coalesce_label bounded_impute one_hot_aligned bounds_audit outlier_audit zero_collapse baseline_table split_audit checks "
    "redundancy_index univariate_signal binned_mi rank_fusion auroc_ap holdout_summary union_widen unseen_levels composition ml_logit ml_forest ml_holdouts ml_importance ml_sweep"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
