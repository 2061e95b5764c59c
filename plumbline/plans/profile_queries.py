"""Value, profiling, observation and key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, values as V
from ..operators import keys, match, notes, observe, profile, sniff, spelling
from . import derive as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT c_custkey, upper(left(c_name, 8)) AS a, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 12, '0') AS b, regexp_replace(regexp_replace(c_name, '[^0-9]', '', 'g'), '^0+', '') AS c, split_part(c_name, '#', 2) AS d,
 replace(lower(c_mktsegment), 'a', '@') AS e, length(c_name)::VARCHAR AS f, right(c_mktsegment, 3) || '' AS g, left(c_mktsegment, -2) AS h, regexp_replace(c_mktsegment, '([A-Z])([A-Z])', '\\2\\1', 'g') AS i FROM customer""")
def steps_text(s, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    steps = {
        "a": (n, [("left", 8), ("upper",)]), "b": (n, [("digits_only",), ("pad_left", 12)]), "c": (n, [("digits_only",), ("strip_leading_zeros",)]), "d": (n, [("split_part", "#", 2)]), "e": (m, [("lower",), ("replace", "a", "@")]),
        "f": (n, [("length",)]), "g": (m, [("right", 3)]), "h": (m, [("left", -2)]), "i": (m, [("regex_replace", "([A-Z])([A-Z])", "\\2\\1")]),
    }
    return D.table(s, d, "customer").select("c_custkey", *[V.apply_steps(x, todo).alias(k) for k, (x, todo) in steps.items()])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, rtrim(rtrim(l_extendedprice::DECIMAL(18,8)::VARCHAR, '0'), '.') AS price, rtrim(rtrim(((l_partkey % 1000)::DECIMAL(18,8) / 8)::DECIMAL(18,8)::VARCHAR, '0'), '.') AS part FROM lineitem""")
def canon_number(s, d):
    t = D.table(s, d, "lineitem")
    part = F.concat(F.lit(" 0"), ((F.col("l_partkey") % 1000).cast("decimal(18,8)") / 8).cast("decimal(28,8)").cast("string"), F.lit("000"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", V.canon_number(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("price"), V.canon_number(F.regexp_replace(part, "000$", "")).alias("part"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS iso, o_orderdate::DATE::VARCHAR AS dmy, o_orderdate::DATE::VARCHAR AS named, o_orderdate::DATE::VARCHAR AS short, 'no date' AS none FROM orders")
def canon_date(s, d):
    x = F.col("o_orderdate")
    text = {"iso": F.date_format(x, "yyyy-MM-dd HH:mm:ss"), "dmy": F.date_format(x, "d/M/yyyy"), "named": F.date_format(x, "dd-MMM-yyyy"), "short": F.date_format(x, "dd/MM/yy"), "none": F.lit("no date")}
    return D.table(s, d, "orders").select("o_orderkey", *[V.canon_date(t).alias(k) for k, t in text.items()])


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def canon_timestamp(s, d):
    return D.table(s, d, "events").select("event_id", V.canon_timestamp(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), ["%d/%m/%Y %H:%M:%S"]).alias("stamp"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE 'maybe' END AS flag FROM orders")
def canon_bool(s, d):
    k = F.col("o_orderkey") % 4
    return D.table(s, d, "orders").select("o_orderkey", V.canon_boolean(F.when(k == 0, " Y ").when(k == 1, "No").when(k == 2, "1").otherwise("maybe")).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN NULL ELSE o_orderpriority END AS folded FROM orders")
def null_fold(s, d):
    k = F.col("o_orderkey") % 5
    return D.table(s, d, "orders").select("o_orderkey", V.null_fold(F.when(k == 0, " n/a ").when(k == 1, "").when(k == 2, "None").otherwise(F.col("o_orderpriority"))).alias("folded"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'x' || o_orderkey ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS v FROM orders)
SELECT count(v) AS filled, count(*) FILTER (v NOT LIKE 'x%') AS converted, count(*) FILTER (v LIKE 'x%') AS failed, round(100.0::DOUBLE * count(*) FILTER (v LIKE 'x%') / count(v), 2) AS failed_percent, min(v) FILTER (v LIKE 'x%') AS first_failed, max(v) FILTER (v LIKE 'x%') AS last_failed, min(v) AS before, rtrim(rtrim(min(v), '0'), '.') AS after FROM t""")
def conversion_report(s, d):
    t = D.left(s, d).withColumn("v", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_totalprice")))
    return V.conversion_report(t, "v", "number")


_P = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
_STAT = """SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values, min({c}::VARCHAR) AS min_text, max({c}::VARCHAR) AS max_text, {lo}::DOUBLE AS min_number, {hi}::DOUBLE AS max_number, {mean}::DOUBLE AS mean,
 min(length({c}::VARCHAR))::INTEGER AS min_length, max(length({c}::VARCHAR))::INTEGER AS max_length, round(avg(length({c}::VARCHAR)), 4) AS mean_length, count(*) - count({c}) AS nulls, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_percent, round(100.0::DOUBLE * count(DISTINCT {c}) / count({c}), 2) AS distinct_percent FROM customer"""


@query(" UNION ALL ".join(_STAT.format(c=c, **({"lo": f"min({c})", "hi": f"max({c})", "mean": f"round(avg({c}), 4)"} if c.endswith("key") else {"lo": "NULL", "hi": "NULL", "mean": "NULL"})) for c in _P))
def prof_stats(s, d):
    return profile.statistics(D.table(s, d, "customer"), _P, ["c_custkey", "c_nationkey"])


_LP = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
_LN = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(" UNION ALL ".join(_STAT.replace("FROM customer", "FROM (SELECT * REPLACE (l_quantity::DECIMAL(18,2) AS l_quantity) FROM lineitem)").format(c=c, **({"lo": f"min({c})", "hi": f"max({c})", "mean": f"round(avg({c}), 4)"} if c in _LN else {"lo": "NULL", "hi": "NULL", "mean": "NULL"})) for c in _LP))
def prof_stats_lines(s, d):
    return profile.statistics(D.table(s, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)")), _LP, _LN)


def _freq(order: str) -> str:
    return "WITH f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM customer GROUP BY 2" for c in ("c_nationkey", "c_mktsegment")) + f"), g AS (SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY column_name), 2) AS percent, row_number() OVER (PARTITION BY column_name ORDER BY n {order}, value NULLS LAST)::INTEGER AS rank FROM f) SELECT * FROM g WHERE rank <= 5"


@query(_freq("DESC"))
def prof_freq_top(s, d):
    return profile.top_values(D.table(s, d, "customer"), ["c_nationkey", "c_mktsegment"], 5)


@query(_freq("ASC"))
def prof_freq_bottom(s, d):
    return profile.top_values(D.table(s, d, "customer"), ["c_nationkey", "c_mktsegment"], 5, least=True)


@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT CASE WHEN lo = hi THEN 0 ELSE least(floor((l_quantity - lo) / ((hi - lo) / 7)), 6) END::INTEGER AS bin, lo, hi FROM lineitem, e)
SELECT bin, lo + bin * ((hi - lo) / 7) AS low, CASE WHEN bin = 6 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 7) END AS high, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def prof_hist(s, d):
    return profile.histogram(D.table(s, d, "lineitem"), F.col("l_quantity"), 7)


@query("""WITH x AS (SELECT CASE WHEN floor(abs(l_extendedprice)) < 1 THEN 0 ELSE length(floor(abs(l_extendedprice))::BIGINT::VARCHAR) END AS k FROM lineitem) SELECT CASE WHEN k = 0 THEN '0' WHEN k >= 16 THEN '16+' ELSE ((k - 1) // 3 * 3 + 1) || '-' || ((k - 1) // 3 * 3 + 3) END AS band, count(*) AS n FROM x GROUP BY 1""")
def prof_parts_number(s, d):
    return profile.number_parts(D.table(s, d, "lineitem"), F.col("l_extendedprice"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS part, {e}::INTEGER AS value, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 2" for k, e in {"year": "year(ts)", "month": "month(ts)", "weekday": "isodow(ts)", "hour": "hour(ts)"}.items()))
def prof_parts_date(s, d):
    return profile.date_parts(D.table(s, d, "events"), F.col("ts"))


@query("SELECT 'first' AS part, left(p_name, 2) AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'last', right(p_name, 2), count(*) FROM part GROUP BY 2")
def prof_parts_text(s, d):
    return profile.text_parts(D.table(s, d, "part"), F.col("p_name"))


@query("""WITH x AS (SELECT c_acctbal AS x, CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal = 0 THEN 0 WHEN c_acctbal < 1 THEN 1 ELSE length(floor(c_acctbal)::BIGINT::VARCHAR) + 1 END::INTEGER AS place FROM customer)
SELECT place, count(*) AS n, count(DISTINCT x) AS distinct_values, CASE place WHEN -1 THEN '<0' WHEN 0 THEN '0' WHEN 1 THEN '0-1' ELSE '1e' || (place - 2) END AS bin FROM x GROUP BY place""")
def prof_number_bins(s, d):
    return profile.magnitude_bins(D.table(s, d, "customer"), F.col("c_acctbal"))


@query("""WITH t AS (SELECT regexp_replace(c_acctbal::DECIMAL(18,2)::VARCHAR, '^[+-]?0*', '') AS t FROM customer), k AS (SELECT max(length(split_part(t, '.', 1)))::INTEGER AS before, max(length(rtrim(split_part(t, '.', 2), '0')))::INTEGER AS places FROM t)
SELECT *, 'DECIMAL(' || greatest(1, before + places) || ', ' || places || ')' AS fits FROM k""")
def prof_decimal_fit(s, d):
    return profile.decimal_fit(D.table(s, d, "customer"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))


_NV = """v AS (SELECT round(o_totalprice / 10)::BIGINT * 10::DOUBLE AS value FROM orders), c AS (SELECT value, count(*) AS n FROM v GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c QUALIFY rank <= 40),
 k AS (SELECT *, count(*) FILTER (value <> 0 AND value % 1000 = 0) OVER () AS many FROM t), l AS (SELECT value, n, row_number() OVER (ORDER BY rank) AS rank FROM k WHERE value <> 0 AND value % CASE WHEN many > 0 THEN 1000 ELSE 100 END = 0), o AS (SELECT value, n, row_number() OVER (ORDER BY value) AS rank FROM c WHERE n = 1 QUALIFY rank <= 40)"""


@query(f"WITH {_NV} SELECT 'top' AS part, value, n, rank FROM t UNION ALL SELECT 'lot', * FROM l UNION ALL SELECT 'once', * FROM o")
def prof_number_values(s, d):
    return profile.number_values(D.table(s, d, "orders"), F.round(F.col("o_totalprice") / 10) * 10, 40)


@query("SELECT strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS value, count(*) AS n, isodow(o_orderdate)::INTEGER AS weekday FROM orders GROUP BY o_orderdate HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 10")
def prof_time_repeats(s, d):
    return profile.time_repeats(D.table(s, d, "orders"), F.col("o_orderdate"))


_TP = "t AS (SELECT o_orderdate::TIMESTAMP + to_microseconds((o_custkey % 4) * 250000 + CASE WHEN o_orderkey % 5 = 0 THEN 1250 ELSE 0 END) AS d FROM orders)"


@query(f"WITH {_TP} SELECT count(*) AS filled, max(length(rtrim(lpad((epoch_us(d) % 1000000)::VARCHAR, 6, '0'), '0')))::INTEGER AS fraction_digits, count(*) FILTER (epoch_us(d) % 1000 = 0) AS whole_ms, count(*) FILTER (epoch_us(d) % 1000000 = 0) AS whole_seconds FROM t")
def prof_time_precision(s, d):
    micros = (F.col("o_custkey") % 4) * 250_000 + F.when(F.col("o_orderkey") % 5 == 0, 1250).otherwise(0)
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + micros)
    return profile.time_precision(D.table(s, d, "orders"), at)


_TW = "t AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%m-%d-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:11:12.' || (o_custkey % 100) END AS t FROM orders)"


@query(f"WITH {_TW}, h AS (SELECT *, regexp_replace(t, '[0-9]', '9', 'g') AS shape, length(regexp_extract(t, ':[0-9]{{2}}[.]([0-9]+)', 1))::VARCHAR AS f, try_cast(regexp_extract(t, '^([0-9]{{1,2}})[/.-]', 1) AS INT) AS a, try_cast(regexp_extract(t, '^[0-9]{{1,2}}[/.-]([0-9]{{1,2}})[/.-]', 1) AS INT) AS b FROM t) "
       "SELECT 'shape' AS part, shape AS value, count(*) AS n, min(t) AS example FROM h GROUP BY shape UNION ALL SELECT 'fraction', f, count(*), min(t) FROM h GROUP BY f UNION ALL SELECT 'first_over_12', NULL, count(*), min(t) FROM h WHERE a > 12 UNION ALL SELECT 'second_over_12', NULL, count(*), min(t) FROM h WHERE b > 12")  # fmt: skip
def prof_time_written(s, d):
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    late = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:11:12."), (F.col("o_custkey") % 100).cast("string"))
    return profile.time_written(D.table(s, d, "orders"), F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "MM-dd-yyyy")).otherwise(late))


@query("""SELECT count(d) AS filled, count(DISTINCT d) AS distinct_values, strftime(min(d), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(d), '%Y-%m-%d %H:%M:%S') AS last, date_diff('day', min(d)::DATE, max(d)::DATE)::INTEGER AS days, count(*) FILTER (strftime(d, '%H:%M:%S') = '00:00:00') AS midnight,
 count(*) FILTER (d::DATE::VARCHAR IN ('1900-01-01', '1970-01-01', '9999-12-31', '0001-01-01')) AS placeholders, count(*) FILTER (isodow(d) >= 6) AS weekend, count(*) FILTER (day(d) = 1) AS month_starts, count(*) FILTER (d > TIMESTAMP '1996-01-01') AS future, count(*) FILTER (year(d) < 1900) AS before_1900 FROM (SELECT o_orderdate::TIMESTAMP AS d FROM orders)""")
def prof_when_facts(s, d):
    return profile.time_facts(D.table(s, d, "orders"), F.col("o_orderdate"), "1996-01-01")


@query("WITH c AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bin, count(*) AS n FROM orders WHERE month(o_orderdate) <> 5 GROUP BY 1), e AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 MONTH)) AS bin FROM c) SELECT bin, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (bin)")
def prof_when_bins(s, d):
    return profile.time_bins(D.table(s, d, "orders").filter("month(o_orderdate) <> 5"), F.col("o_orderdate"))


@query("""WITH t AS (SELECT hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events), q AS (SELECT quantile_cont(s, 0.25)::DOUBLE AS q1, quantile_cont(s, 0.75)::DOUBLE AS q3 FROM t), f AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS low, q3 + 1.5::DOUBLE * (q3 - q1) AS high FROM q)
SELECT q1, q3, low, high, count(*) FILTER (s < low) AS before, count(*) FILTER (s > high) AS after FROM t, f GROUP BY ALL""")
def prof_session(s, d):
    return profile.session_fences(D.table(s, d, "events"), F.col("ts"))


@query("SELECT year(l_shipdate)::INTEGER AS group_value, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS true_n, round(100.0::DOUBLE * count(*) FILTER (l_returnflag = 'R') / count(*), 2) AS rate FROM lineitem GROUP BY 1")
def prof_flag_rates(s, d):
    return profile.true_rates(D.table(s, d, "lineitem"), F.col("l_returnflag") == "R", F.year("l_shipdate"))


@query("""WITH b AS (SELECT c_acctbal AS x, c_mktsegment = 'BUILDING' AS f, ntile(5) OVER (ORDER BY c_acctbal, c_custkey)::INTEGER AS band FROM customer)
SELECT band, min(x) AS low, max(x) AS high, count(f) AS n, count(*) FILTER (f) AS true_n, round(100.0::DOUBLE * count(*) FILTER (f) / count(f), 2) AS rate FROM b GROUP BY band""")
def prof_bands(s, d):
    return profile.number_bands(D.table(s, d, "customer"), F.col("c_acctbal"), F.col("c_mktsegment") == "BUILDING", order=["c_custkey"])


@query("SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT AS duplicates FROM lineitem")
def obs_duplicates(s, d):
    return observe.duplicate_rows(D.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("""WITH g AS (SELECT c_nationkey, count(DISTINCT c_nationkey % 5) = 1 AS a, count(DISTINCT c_mktsegment) = 1 AS b FROM customer GROUP BY 1) SELECT 'mod' AS column_name, bool_and(a) AS decided FROM g UNION ALL SELECT 'c_mktsegment', bool_and(b) FROM g""")
def obs_fd(s, d):
    return observe.decides(D.table(s, d, "customer").withColumn("mod", F.col("c_nationkey") % 5), "c_nationkey", ["mod", "c_mktsegment"])


_CORR = ("l_extendedprice", "net", "l_quantity", "l_discount", "one")


@query("WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) - l_quantity AS net, 1.0::DOUBLE AS one FROM lineitem), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM t" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]) + ") SELECT * FROM p WHERE abs(r) >= 0.3 AND NOT isnan(r)")
def obs_corr(s, d):
    t = D.table(s, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_quantity")).withColumn("one", F.lit(1.0))
    return observe.correlations(t, list(_CORR), 0.3)


_Q = ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in observe.PERCENTS)


@query(" UNION ALL ".join(f"""SELECT q.*, (SELECT count(*) FROM {t} WHERE {c} < p25 - 1.5 * (p75 - p25)) AS below, (SELECT count(*) FROM {t} WHERE {c} > p75 + 1.5 * (p75 - p25)) AS above, 0::BIGINT AS left_out FROM (SELECT '{c}' AS column_name, count(x) AS filled, min(x) AS lowest, max(x) AS highest, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x < 0) AS negatives, {_Q}, round(stddev_samp(x), 4) AS deviation FROM (SELECT {c} AS x FROM {t})) q""" for t, c in (("customer", "c_acctbal"), ("customer", "c_odd"))).replace("FROM customer", "FROM (SELECT *, CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 20 ELSE c_acctbal END AS c_odd FROM customer)"))
def obs_outliers(s, d):
    t = D.table(s, d, "customer").withColumn("c_odd", F.when(F.col("c_custkey") % 97 == 0, F.col("c_acctbal") * 20).otherwise(F.col("c_acctbal")))
    out = observe.outliers(t, ["c_acctbal", "c_odd"])
    return out.select("column_name", "filled", "lowest", "highest", "zeros", "negatives", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in observe.PERCENTS], F.round("deviation", 4).alias("deviation"), "below", "above", "left_out")


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"""SELECT q.*, (SELECT count(*) FROM lineitem WHERE {c} < p25 - 1.5 * (p75 - p25)) AS below, (SELECT count(*) FROM lineitem WHERE {c} > p75 + 1.5 * (p75 - p25)) AS above FROM (SELECT '{c}' AS column_name, count(x) AS filled, min(x) AS lowest, max(x) AS highest, {_Q} FROM (SELECT {c} AS x FROM lineitem)) q""" for c in _LINE_NUMBERS))
def obs_outliers_lines(s, d):
    out = observe.outliers(D.table(s, d, "lineitem"), _LINE_NUMBERS)
    return out.select("column_name", "filled", "lowest", "highest", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in observe.PERCENTS], "below", "above")


@query("""WITH s AS (SELECT 'p_brand' AS column_name, regexp_replace(regexp_replace(p_brand, '\\p{L}', 'A', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n, min(p_brand) AS example FROM part GROUP BY 2 UNION ALL SELECT 'p_name', regexp_replace(regexp_replace(p_name, '\\p{L}', 'A', 'g'), '[0-9]', '9', 'g'), count(*), min(p_name) FROM part GROUP BY 2),
r AS (SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY column_name), 2) AS percent, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, shape)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def obs_shapes(s, d):
    return observe.shapes(D.table(s, d, "part"), ["p_brand", "p_name"])


@query("""WITH t AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN ' ' || c_mktsegment WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 5 = 0 THEN '0' || c_custkey ELSE c_mktsegment END AS v FROM customer)
SELECT 'v' AS column_name, count(*) FILTER (v <> trim(v)) AS padded, count(DISTINCT v) - count(DISTINCT lower(v)) AS case_variants, count(*) FILTER (regexp_matches(v, '^0[0-9]+$')) AS leading_zeros FROM t""")
def obs_raw_checks(s, d):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    v = F.when(k % 9 == 0, F.concat(F.lit(" "), m)).when(k % 7 == 0, F.lower(m)).when(k % 5 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(m)
    return observe.raw_checks(D.table(s, d, "customer").select(v.alias("v")), ["v"])


_NK = "(SELECT *, CASE WHEN o_orderkey % 23 <> 0 THEN o_custkey END AS k FROM orders)"


@query(f"WITH g AS (SELECT k, o_orderstatus, count(*) AS n FROM {_NK} GROUP BY 1, 2) SELECT sum(n)::BIGINT AS rows, count(*) FILTER (k IS NOT NULL AND o_orderstatus IS NOT NULL) AS distinct_keys, (sum(n) FILTER (k IS NOT NULL AND o_orderstatus IS NOT NULL) - count(*) FILTER (k IS NOT NULL AND o_orderstatus IS NOT NULL))::BIGINT AS duplicate_rows, (sum(n) FILTER (k IS NULL OR o_orderstatus IS NULL))::BIGINT AS null_keys FROM g")
def key_uniqueness(s, d):
    return keys.uniqueness(D.table(s, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 23 != 0, F.col("o_custkey"))), ["k", "o_orderstatus"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 10")
def key_combo_top(s, d):
    return keys.repeated(D.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(DISTINCT c_custkey) AS left_keys, count(DISTINCT c_custkey) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS found, round(100.0::DOUBLE * count(DISTINCT c_custkey) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(DISTINCT c_custkey), 2) AS share FROM customer")
def key_overlap(s, d):
    o = D.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return match.overlap(D.table(s, d, "customer"), o, ["c_custkey"])


@query("WITH o AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 10000000 END AS k FROM orders) SELECT count(DISTINCT c_custkey) AS left_keys, count(DISTINCT c_custkey) FILTER (c_custkey IN (SELECT k FROM o)) AS found, round(100.0::DOUBLE * count(DISTINCT c_custkey) FILTER (c_custkey IN (SELECT k FROM o)) / count(DISTINCT c_custkey), 2) AS share FROM customer")
def key_overlap_whole(s, d):
    k = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 10_000_000)
    return match.overlap(D.table(s, d, "customer"), D.table(s, d, "orders").select(k.alias("c_custkey")), ["c_custkey"])


_RUNS = "WITH v AS (SELECT DISTINCT o_orderkey AS x FROM orders WHERE o_orderkey % 1000 > 30 AND o_custkey % 50 <> 7), g AS (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM v), runs AS (SELECT min(x) AS low, max(x) AS high, count(*) AS size FROM g GROUP BY g)"
_holes = lambda s, d: D.table(s, d, "orders").filter("o_orderkey % 1000 > 30 and o_custkey % 50 <> 7")


@query(_RUNS + " SELECT * FROM runs")
def key_islands(s, d):
    return keys.islands(_holes(s, d), F.col("o_orderkey"))


@query(_RUNS + ", n AS (SELECT *, lead(low) OVER (ORDER BY low) AS next FROM runs) SELECT high + 1 AS low, next - 1 AS high, next - high - 1 AS size FROM n WHERE next IS NOT NULL ORDER BY 3 DESC, 1 LIMIT 20")
def key_gaps(s, d):
    return keys.gaps(_holes(s, d), F.col("o_orderkey"))


@query("WITH v AS (SELECT o_totalprice AS v, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS b, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS h FROM orders) SELECT count(*) FILTER (v > b) AS ascents, count(*) FILTER (v < b) AS descents, count(*) FILTER (v = b) AS equal FROM v WHERE h IS NOT NULL")
def key_order(s, d):
    return keys.order_in_file(D.table(s, d, "orders"), F.col("o_totalprice"), "o_orderkey", 5000)


@query("""SELECT count(*) AS rows, count(c_name) AS filled, count(DISTINCT c_name) AS distinct_values, count(c_name) - count(DISTINCT c_name) AS duplicates, count(DISTINCT c_name) - count(DISTINCT lower(c_name)) AS case_variants, count(DISTINCT c_name) - count(DISTINCT trim(c_name)) AS space_variants,
 min(length(c_name))::INTEGER AS min_width, max(length(c_name))::INTEGER AS max_width, min(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1)::BIGINT) AS least_number, max(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1)::BIGINT) AS greatest_number FROM customer""")
def key_facts(s, d):
    return keys.key_facts(D.table(s, d, "customer"), "c_name")


@query("""WITH a AS (SELECT DISTINCT c_custkey::VARCHAR AS v FROM customer), b AS (SELECT DISTINCT o_custkey::VARCHAR AS v FROM orders) SELECT (SELECT count(*) FROM a) AS left_values, (SELECT count(*) FROM b) AS right_values, (SELECT count(*) FROM a SEMI JOIN b USING (v)) AS met, false AS left_merged, false AS right_merged""")
def keyformat_share(s, d):
    a = D.table(s, d, "customer").select(F.format_string("C%09d", "c_custkey").alias("k"))
    return keys.meet_share(a, D.table(s, d, "orders"), "k", "o_custkey", [("digits_only",), ("strip_leading_zeros",)])


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS columns, count(DISTINCT {c}) AS distinct_values, count(*) AS rows FROM customer" for c in ("c_custkey", "c_nationkey", "c_mktsegment")) + ") SELECT columns, distinct_values FROM c WHERE distinct_values = rows")
def key_search(s, d):
    t = D.table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return s.createDataFrame([(",".join(c.columns), c.distinct) for c in keys.search(t)], "columns string, distinct_values long")


@query("""WITH v AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN p_type || '.' ELSE p_type END AS value FROM part), c AS (SELECT value, count(*) AS n FROM v GROUP BY 1),
f AS (SELECT *, array_to_string(list_sort(list_filter(string_split_regex(lower(value), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')), ' ') AS fingerprint FROM c) SELECT fingerprint, count(*) AS forms, sum(n)::BIGINT AS n, arg_max(value, (n, value)) AS top FROM f GROUP BY 1 HAVING count(*) > 1""")
def spell_fingerprint(s, d):
    k, t = F.col("p_partkey") % 3, F.col("p_type")
    return spelling.fingerprint_groups(D.table(s, d, "part").select(F.when(k == 0, F.upper(t)).when(k == 1, F.concat(t, F.lit("."))).otherwise(t).alias("v")), "v")


@query("""WITH t AS (SELECT o_orderkey // 100 AS batch, o_orderkey % 100 AS place, o_orderstatus AS status, o_orderpriority AS urgency FROM orders),
c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{','.join(c)}', (SELECT count(DISTINCT ({', '.join(c)},)) FROM t))" for c in (("batch",), ("place",), ("status",), ("urgency",), ("batch", "place"), ("batch", "status"), ("batch", "urgency"), ("place", "status"), ("place", "urgency"), ("status", "urgency"))) + """) v(columns, distinct_values))
SELECT columns, distinct_values FROM c WHERE distinct_values = (SELECT count(*) FROM t)""")
def key_search_pair(s, d):
    k = F.col("o_orderkey")
    t = D.table(s, d, "orders").select(F.floor(k / 100).alias("batch"), (k % 100).alias("place"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("urgency"))
    return s.createDataFrame([(",".join(c.columns), c.distinct) for c in keys.search(t)], "columns string, distinct_values long")


@query("""WITH c AS (SELECT c_name AS value, c_nationkey::VARCHAR AS other, count(*) AS n FROM customer GROUP BY 1, 2) SELECT other, count(*) AS forms, sum(n)::BIGINT AS n, arg_max(value, (n, value)) AS top FROM c GROUP BY 1 HAVING count(*) > 1""")
def spell_same(s, d):
    return spelling.same_other(D.table(s, d, "customer"), "c_name", "c_nationkey")


@query("SELECT 'p_name' AS column_name, word, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'unknown' END AS word FROM part) WHERE word IS NOT NULL GROUP BY 2")
def placeholders(s, d):
    k = F.col("p_partkey") % 4
    return spelling.placeholders(D.table(s, d, "part").withColumn("p_name", F.when(k == 0, " N/A").when(k == 1, "Unknown").otherwise(F.col("p_name"))), ["p_name", "p_brand"])


@query("""WITH t AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS flag, o_totalprice::DECIMAL(18,2)::VARCHAR AS price, o_orderpriority AS word FROM orders), l AS (UNPIVOT t ON COLUMNS(*) INTO NAME column_name VALUE v),
r AS (SELECT column_name, v, coalesce(try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%Y%m%d')) AS stamp FROM l)
SELECT column_name, count(v) AS filled, count(*) FILTER (lower(trim(v)) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f')) AS booleans, count(try_cast(v AS DOUBLE)) AS numbers, count(stamp) AS stamps, count(*) FILTER (strftime(stamp, '%H:%M:%S') <> '00:00:00') AS with_time FROM r GROUP BY 1""")
def sniff_counts(s, d):
    t = D.table(s, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("N").alias("flag"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.col("o_orderpriority").alias("word"))
    return sniff.readings(t, ["day", "flag", "price", "word"])


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def column_values(s, d):
    return spelling.counts(D.table(s, d, "orders"), "o_orderpriority").orderBy(F.desc("n"), "value").limit(3)


@query(_RUNS + ", t AS (SELECT *, o_orderkey > (SELECT high FROM runs ORDER BY size DESC, low LIMIT 1) AS past FROM orders WHERE o_orderkey % 1000 > 30 AND o_custkey % 50 <> 7) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (past) AS rows_past, count(DISTINCT {c}) FILTER (past) AS distinct_past, count(DISTINCT {c}) AS distinct_all FROM t" for c in ("o_orderstatus", "o_orderdate")))
def key_beyond(s, d):
    return keys.beyond_largest_run(_holes(s, d), F.col("o_orderkey"), ["o_orderstatus", "o_orderdate"])


@query("SELECT count(*) AS rows, count(s_name) AS filled, arg_min(s_name, s_suppkey) AS lowest, arg_max(s_name, s_suppkey) AS highest FROM supplier")
def key_span(s, d):
    return keys.span(D.table(s, d, "supplier"), "s_name")


@query("SELECT count(*) AS rows, count(c_name) AS filled, arg_min(c_name, c_custkey) AS lowest, arg_max(c_name, c_custkey) AS highest FROM customer")
def key_span_whole(s, d):
    return keys.span(D.table(s, d, "customer"), "c_name")


@query("SELECT 'Customer#' || lpad((max(c_custkey) + 1)::VARCHAR, 9, '0') AS next FROM customer")
def key_next(s, d):
    return s.createDataFrame([(keys.next_key(D.table(s, d, "customer"), "c_name"),)], "next string")


@query("SELECT l_returnflag = 'R' AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def prof_flag_counts(s, d):
    return profile.flag_counts(D.table(s, d, "lineitem"), F.col("l_returnflag") == "R")


@query("WITH c AS (SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1) SELECT lower(left(value, 6)) AS prefix, count(*) AS forms, sum(n)::BIGINT AS n FROM c GROUP BY 1 HAVING count(*) > 1")
def spell_prefix(s, d):
    return spelling.prefix_groups(D.table(s, d, "part"), "p_name")


@query("""WITH v AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN lower(p_type) ELSE p_type END AS v FROM part), c AS (SELECT v, count(*) AS n FROM v GROUP BY 1)
SELECT lower(v) AS low, count(*) AS forms, sum(n)::BIGINT AS n, string_agg(v, '|' ORDER BY n DESC, encode(v)) AS spellings FROM c GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""")
def obs_worst_case(s, d):
    k, t = F.col("p_partkey") % 3, F.col("p_type")
    out = observe.worst_case_group(D.table(s, d, "part").select(F.when(k == 0, F.upper(t)).when(k == 1, F.lower(t)).otherwise(t).alias("v")), "v")
    return out.withColumn("spellings", F.array_join("spellings", "|"))


_DM = ("c_nationkey", "fifth", "c_mktsegment")
_DM_SQL = "t AS (SELECT *, c_nationkey % 5 AS fifth FROM customer)"


@query(f"WITH {_DM_SQL}, p AS (" + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, count(*)::DOUBLE AS n, count(DISTINCT {x})::DOUBLE AS dx, count(DISTINCT {y})::DOUBLE AS dy, count(DISTINCT ({x}, {y}))::DOUBLE AS dxy FROM t" for x in _DM for y in _DM if x != y) + """),
c AS (SELECT *, 1 / (dy * (1 - pow(1 - 1 / dy, n / dx))) AS chance FROM p) SELECT a, b, CASE WHEN chance >= 1 THEN 0 ELSE round(100 * greatest(0, (dx / dxy - chance) / (1 - chance)), 2) END::DOUBLE AS score FROM c""")
def obs_dependency_matrix(s, d):
    t = D.table(s, d, "customer").withColumn("fifth", F.col("c_nationkey") % 5)
    return s.createDataFrame(observe.dependency_matrix(t, _DM), "a string, b string, score double")


@query(f"WITH {_DM_SQL}, g AS (SELECT c_nationkey, count(DISTINCT fifth) = 1 AS one FROM t GROUP BY 1) SELECT 'c_nationkey' AS a, 'fifth' AS b FROM g HAVING bool_and(one)")
def obs_dependencies(s, d):
    t = D.table(s, d, "customer").withColumn("fifth", F.col("c_nationkey") % 5)
    return s.createDataFrame(observe.dependencies(t, _DM), "a string, b string")


@query("WITH t AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v FROM orders) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS format, count(try_strptime(v, '{f}')) AS n, round(count(try_strptime(v, '{f}'))::DOUBLE / count(*), 4) AS share FROM t" for f in dates.PRESETS.values()) + ") WHERE n > 0")
def sniff_formats(s, d):
    x = F.col("o_orderdate")
    t = D.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(x, "dd/MM/yyyy")).otherwise(F.date_format(x, "yyyy-MM-dd")).alias("day"))
    return sniff.formats_that_read(t, "day")


@query("WITH t AS (SELECT strftime(o_orderdate, '%d/%m/%Y %H:%M') AS v FROM orders), f AS (" + " UNION ALL ".join(f"SELECT '{f}' AS format, count(try_strptime(v, '{f}'))::DOUBLE / count(*) AS share FROM t" for f in dates.PRESETS.values()) + """),
g AS (SELECT format FROM f WHERE share >= 0.98 AND replace(format, '%Y', '%y') NOT IN (SELECT format FROM f WHERE share >= 0.98 AND contains(format, '%y'))), n AS (SELECT count(try_cast(v AS DOUBLE))::DOUBLE / count(*) AS numbers, count(*) FILTER (lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f'))::DOUBLE / count(*) AS booleans FROM t)
SELECT 'text' AS kind, NULL::VARCHAR AS format UNION ALL SELECT 'number', NULL FROM n WHERE numbers >= 0.98 UNION ALL SELECT 'boolean', NULL FROM n WHERE booleans >= 0.98 UNION ALL SELECT CASE WHEN regexp_matches(format, '%[HI]') THEN 'timestamp' ELSE 'date' END, format FROM g""")
def sniff_possible(s, d):
    return sniff.possible_kinds(D.table(s, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm").alias("at")), "at")


_SUM = ["c_name", "c_nationkey", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS filled, round(100.0::DOUBLE * count({c}) / count(*), 2) AS filled_percent, count(DISTINCT {c}) AS distinct_values, any_value(t) AS top, round(100.0::DOUBLE * any_value(n) / count(*), 2) AS top_percent FROM customer, (SELECT {c}::VARCHAR AS t, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)" for c in _SUM))
def prof_column_summary(s, d):
    return profile.column_summary(D.table(s, d, "customer"), _SUM)


_DQ = ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in observe.PERCENTS)


@query(" UNION ALL ".join(f"""SELECT q.*, (SELECT count(*) FROM lineitem WHERE epoch({c}::TIMESTAMP) < p25 - 1.5 * (p75 - p25)) AS below, (SELECT count(*) FROM lineitem WHERE epoch({c}::TIMESTAMP) > p75 + 1.5 * (p75 - p25)) AS above FROM (SELECT '{c}' AS column_name, count(x) AS filled, {_DQ}, strftime(min(d), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(d), '%Y-%m-%d %H:%M:%S') AS last,
 count(*) FILTER (d > TIMESTAMP '1997-06-30') AS future, count(*) FILTER (year(d) < 1900) AS before_1900 FROM (SELECT {c}::TIMESTAMP AS d, epoch({c}::TIMESTAMP) AS x FROM lineitem)) q""" for c in ("l_shipdate",)))
def obs_date_outliers(s, d):
    out = observe.date_outliers(D.table(s, d, "lineitem"), ["l_shipdate"], "1997-06-30")
    return out.select("column_name", "filled", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in observe.PERCENTS], "below", "above", "first", "last", "future", "before_1900")


@query("""WITH v AS (SELECT CASE WHEN c_custkey % 31 = 0 THEN c_name || '-' || c_nationkey ELSE c_name END AS v FROM customer), s AS (SELECT v, regexp_replace(regexp_replace(v, '\\p{L}', 'A', 'g'), '[0-9]', '9', 'g') AS shape FROM v),
g AS (SELECT shape, count(*) AS n FROM s GROUP BY 1), t AS (SELECT shape, n FROM g ORDER BY n DESC, shape LIMIT 1), o AS (SELECT DISTINCT v FROM s WHERE shape <> (SELECT shape FROM t))
SELECT 'name' AS column_name, shape, round(100.0::DOUBLE * n / (SELECT count(*) FROM s), 2) AS percent, (SELECT count(*) FROM s) - n AS others, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT v FROM o ORDER BY v LIMIT 3)) AS examples, (SELECT count(*) FROM o) > 3 AS more FROM t""")
def obs_odd_shapes(s, d):
    name = F.when(F.col("c_custkey") % 31 == 0, F.concat_ws("-", "c_name", "c_nationkey")).otherwise(F.col("c_name"))
    out = observe.odd_shapes(D.table(s, d, "customer").select(name.alias("name"), "c_mktsegment"), ["name", "c_mktsegment"])
    return out.withColumn("examples", F.array_join("examples", "|"))


_COMBO = lambda same: f"""SELECT {same} AS nulls_same, sum(n)::BIGINT AS rows, {'count(*)' if same == 'true' else '(count(*) FILTER (NOT bad) + coalesce(sum(n) FILTER (bad), 0))::BIGINT'} AS distinct_keys, (sum(n) - {'count(*)' if same == 'true' else '(count(*) FILTER (NOT bad) + coalesce(sum(n) FILTER (bad), 0))'})::BIGINT AS duplicate_rows,
 coalesce(sum(n) FILTER (bad), 0)::BIGINT AS null_keys, false AS is_unique, (sum(n) FILTER (k IS NULL))::BIGINT AS null_k, (sum(n) FILTER (o_orderstatus IS NULL))::BIGINT AS null_status FROM (SELECT k, o_orderstatus, count(*) AS n, k IS NULL OR o_orderstatus IS NULL AS bad FROM {_NK} GROUP BY 1, 2)"""  # noqa: E731


@query(_COMBO("false") + " UNION ALL " + _COMBO("true"))
def key_combo(s, d):
    t = D.table(s, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 23 != 0, F.col("o_custkey")))
    one = lambda same: keys.combo(t, ["k", "o_orderstatus"], same).select(F.lit(same).alias("nulls_same"), "*", F.col("nulls_by_column")["k"].alias("null_k"), F.try_element_at("nulls_by_column", F.lit("o_orderstatus")).alias("null_status")).drop("nulls_by_column")
    return one(False).unionByName(one(True))


@query("""SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') AS date, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d 13:00:00') AS hour, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d 13:45:00') AS minute,
 strftime(o_orderdate::TIMESTAMP, '%Y-%m') AS month, year(o_orderdate::TIMESTAMP)::VARCHAR AS year, upper(o_orderstatus) AS upper, round(o_totalprice::DOUBLE, 2) AS round FROM orders""")
def derived_columns(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    t = D.table(s, d, "orders").select("o_orderkey", F.concat(day, F.lit(" 13:45:10")).alias("at"), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("status"), F.col("o_totalprice").cast("string").alias("price"))
    of = {"upper": "status", "round": "price"}
    out = t.select("o_orderkey", *[V.derived(name, F.col(of.get(name, "at"))).alias(name) for name in V.DERIVED])
    return out.withColumn("round", F.col("round").cast("double"))


_SPELLED = "SELECT strftime(o_orderdate::TIMESTAMP, '%m/%d/%Y') AS us, CASE WHEN day(o_orderdate::DATE) <= 12 THEN strftime(o_orderdate::TIMESTAMP, '%d/%m/%Y') ELSE strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') END AS mixed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE format('{:,}', (o_totalprice * 10)::BIGINT) END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS flag FROM orders"


@query(f"""WITH t AS ({_SPELLED}), l AS (SELECT 'us' AS column_name, us AS v FROM t UNION ALL SELECT 'mixed', mixed FROM t UNION ALL SELECT 'price', price FROM t UNION ALL SELECT 'flag', flag FROM t),
r AS (SELECT *, try_strptime(v, '%Y-%m-%d') AS iso, try_strptime(v, '%d/%m/%Y') AS dmy, try_strptime(v, '%m/%d/%Y') AS mdy FROM l)
SELECT column_name, count(v) AS filled, count(try_cast(v AS DOUBLE)) AS numbers, count(try_cast(replace(v, ',', '') AS DOUBLE)) AS grouped, count(*) FILTER (v IN ('Y', 'N')) AS booleans, count(iso) AS iso, count(dmy) AS day_first, count(mdy) AS month_first, count(coalesce(iso, dmy, mdy)) AS stamps, 0::BIGINT AS with_time FROM r GROUP BY 1""")
def sniff_spellings(s, d):
    x, k = F.col("o_orderdate"), F.col("o_orderkey")
    t = D.table(s, d, "orders").select(
        F.date_format(x, "MM/dd/yyyy").alias("us"), F.when(F.dayofmonth(x) <= 12, F.date_format(x, "dd/MM/yyyy")).otherwise(F.date_format(x, "yyyy-MM-dd")).alias("mixed"),
        F.when(k % 3 != 0, F.format_number(F.round(F.col("o_totalprice") * 10).cast("long"), 0)).alias("price"), F.when(k % 2 == 0, "Y").otherwise("N").alias("flag"),
    )
    return sniff.spellings(t, ["us", "mixed", "price", "flag"])


@query("""SELECT o_orderkey, in_file, after_steps, CASE WHEN after_steps = 'N/A' THEN NULL WHEN x IS NULL THEN after_steps ELSE rtrim(rtrim(x::DECIMAL(18,8)::VARCHAR, '0'), '.') END AS compared_as, CASE WHEN after_steps <> 'N/A' THEN CASE WHEN x IS NOT NULL THEN 'yes' ELSE 'no' END END AS converts
FROM (SELECT *, try_cast(after_steps AS DOUBLE) AS x FROM (SELECT *, replace(in_file, ',', '') AS after_steps FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' WHEN o_orderkey % 7 = 0 THEN 'about ' || o_orderkey ELSE format('{:,}', o_orderkey) || '.50' END AS in_file FROM orders)))""")
def steps_stages(s, d):
    k = F.col("o_orderkey")
    v = F.when(k % 5 == 0, "N/A").when(k % 7 == 0, F.concat(F.lit("about "), k.cast("string"))).otherwise(F.concat(F.format_number(k, 0), F.lit(".50")))
    out = V.stages(D.table(s, d, "orders").select("o_orderkey", v.alias("v")), V.ColSpec("v", kind="number", steps=(("remove_thousands",),)), ["o_orderkey"])
    return out.withColumn("converts", F.when(F.col("converts"), "yes").when(~F.col("converts"), "no"))


_SIDE_COLUMNS = {"few": ("o_orderkey % 3", "o_orderkey % 10"), "gone": ("NULL", "NULL"), "same": ("1", "2"), "key": ("o_orderkey", "o_orderkey + 1")}


@query("WITH " + ", ".join(f"{t} AS (SELECT " + ", ".join(f"({e[i]})::VARCHAR AS {c}" for c, e in _SIDE_COLUMNS.items()) + " FROM orders)" for i, t in enumerate("ab")) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN x = 0 AND y = 0 THEN 'empty' WHEN x <= 1 AND y <= 1 THEN 'constant' WHEN greatest(x, y) > 2 * greatest(least(x, y), 1) THEN 'unlike' END AS note, x AS left_n, y AS right_n FROM (SELECT (SELECT count(DISTINCT {c}) FROM a) AS x, (SELECT count(DISTINCT {c}) FROM b) AS y)" for c in _SIDE_COLUMNS) + ") WHERE note IS NOT NULL")
def prof_side_notes(s, d):
    a, b = (D.table(s, d, "orders").select(*[F.expr(e[i]).cast("string").alias(c) for c, e in _SIDE_COLUMNS.items()]) for i in (0, 1))
    return profile.side_notes(profile.both_sides(a, b, list(_SIDE_COLUMNS)))


# ---- what stands out: customers with a planted case of each finding

_NOTED = {
    "number_id": ("text", "(c_custkey // 2)::VARCHAR", lambda k: (k / 2).cast("long").cast("string")),
    "segment": ("text", "CASE WHEN c_custkey % 9 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END", lambda k: F.when(k % 9 == 0, F.lower("c_mktsegment")).when(k % 10 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment"))),
    "nothing": ("text", "CASE WHEN c_custkey < 0 THEN 'x' END", lambda k: F.when(k < 0, "x")),
    "one": ("text", "CASE WHEN c_custkey > 5 THEN 'x' END", lambda k: F.when(k > 5, "x")),
    "flag": ("text", "CASE WHEN c_custkey % 40 = 0 THEN 'b' ELSE 'a' END", lambda k: F.when(k % 40 == 0, "b").otherwise("a")),
    "name": ("text", "CASE WHEN c_custkey % 31 = 0 THEN c_name || '-' || c_nationkey ELSE c_name END", lambda k: F.when(k % 31 == 0, F.concat_ws("-", "c_name", "c_nationkey")).otherwise(F.col("c_name"))),
    "lot": ("number", "CASE WHEN c_custkey % 45 > 2 THEN lpad((c_custkey % 45)::VARCHAR, 3, '0') ELSE '1' || c_custkey END", lambda k: F.when(k % 45 > 2, F.lpad((k % 45).cast("string"), 3, "0")).otherwise(F.concat(F.lit("1"), k.cast("string")))),
    "worth": ("number", "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN '90000' WHEN c_custkey % 41 = 0 THEN '0.0' ELSE (c_custkey % 100 - 20)::VARCHAR END", lambda k: F.when(k % 11 == 0, None).when(k % 37 == 0, "90000").when(k % 41 == 0, "0.0").otherwise((k % 100 - 20).cast("string"))),
    "day": ("date", "CASE WHEN c_custkey % 60 = 0 THEN '2031-05-05' WHEN c_custkey % 70 = 1 THEN '1850-01-01' ELSE '1995-03-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') END", lambda k: F.when(k % 60 == 0, "2031-05-05").when(k % 70 == 1, "1850-01-01").otherwise(F.concat(F.lit("1995-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))),
}


def _noted_sql() -> str:
    out = []
    for c, (kind, _, _) in _NOTED.items():
        by = f"(SELECT {c} AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1)"
        base = f"(SELECT count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS vals, (SELECT v FROM {by} ORDER BY n DESC, v LIMIT 1) AS top, (SELECT max(n) FROM {by}) AS top_n, {'true' if c.endswith('id') else 'false'} AS named FROM t)"
        listed = lambda n, sep: f"(SELECT string_agg(v, '{sep}' ORDER BY n DESC, v) FROM (SELECT v, n FROM {by} ORDER BY n DESC, v LIMIT {n}))"  # noqa: B023, E731
        rules = {
            "empty": ("rows", "filled = 0", None), "constant": ("filled", "vals = 1", "top"), "nulls": ("rows - filled", "filled > 0 AND filled < rows AND (100 * (rows - filled) >= 5 * rows OR named)", None),
            "unique": ("rows", "vals = rows AND rows > 1", None), "nearly_unique": ("filled - vals", "100 * vals >= 99 * filled AND filled > vals", None), "identifier_repeats": ("filled - vals", "100 * vals < 99 * filled AND filled > vals AND named", None),
            "category": ("vals", "vals BETWEEN 2 AND 20 AND 100 * vals <= 50 * rows", listed(12, ", ") + " || CASE WHEN vals > 12 THEN ', …' ELSE '' END"), "dominant": ("top_n", "vals > 1 AND 100 * top_n >= 95 * rows", "top"),
        }
        count = lambda test: f"(SELECT count(*) FROM t WHERE {test})"
        if kind == "text":
            forms = f"(SELECT lower(v) AS low, count(*) AS forms, sum(n) AS n FROM {by} GROUP BY 1 HAVING count(*) > 1)"
            worst = f"(SELECT string_agg(v, ' / ' ORDER BY n DESC, v) FROM (SELECT v, n FROM {by} WHERE lower(v) = (SELECT low FROM {forms} ORDER BY forms DESC, n DESC, low LIMIT 1) ORDER BY n DESC, v LIMIT 3))"
            shape = "regexp_replace(regexp_replace(v, '\\p{L}', 'A', 'g'), '[0-9]', '9', 'g')"
            top = f"(SELECT {shape} AS s, sum(n) AS k FROM {by} GROUP BY 1 ORDER BY k DESC, s LIMIT 1)"
            odd = f"(SELECT v FROM {by} WHERE {shape} <> (SELECT s FROM {top}))"
            rules |= {
                "padded": (count(f"{c} <> trim({c})"), count(f"{c} <> trim({c})") + " > 0", None), "case": (f"(SELECT sum(forms) FROM {forms})", f"(SELECT count(*) FROM {forms}) > 0", worst),
                "odd_shapes": (f"filled - (SELECT k FROM {top})", f"filled > (SELECT k FROM {top}) AND 100 * (SELECT k FROM {top}) >= 90 * filled", f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM {odd} ORDER BY v LIMIT 3)) || CASE WHEN (SELECT count(*) FROM {odd}) > 3 THEN ', …' ELSE '' END"),
            }
        else:
            x = f"{c}::DOUBLE" if kind == "number" else f"epoch({c}::TIMESTAMP)"
            fence = f"(SELECT quantile_cont({x}, 0.25) AS p, quantile_cont({x}, 0.75) AS q FROM t)"
            outside = f"(SELECT count(*) FROM t, {fence} WHERE {x} < p - 1.5 * (q - p) OR {x} > q + 1.5 * (q - p))"
            found = {"outliers": outside} | ({"negatives": count(f"{x} < 0"), "zeros": count(f"{x} = 0"), "leading_zeros": count(f"regexp_matches({c}, '^0[0-9]')")} if kind == "number" else {"future": count(f"{c}::DATE > DATE '2020-01-01'"), "before_1900": count(f"year({c}::DATE) < 1900")})
            rules |= {name: (n, f"{n} > 0", None) for name, n in found.items()}
        out += [f"SELECT '{c}' AS column_name, '{note}' AS note, ({n})::BIGINT AS n, round(100.0::DOUBLE * ({n}) / rows, 2) AS percent, ({example or 'NULL'})::VARCHAR AS example FROM {base} WHERE {when}" for note, (n, when, example) in rules.items()]
    return "WITH t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, (_, e, _) in _NOTED.items()) + " FROM customer) " + " UNION ALL ".join(out)


@query(_noted_sql())
def obs_notes(s, d):
    t = D.table(s, d, "customer").select(*[make(F.col("c_custkey")).alias(c) for c, (_, _, make) in _NOTED.items()])
    return notes.column_notes(t, {c: kind for c, (kind, _, _) in _NOTED.items()}, "2020-01-01")
