"""Queries over written files, spellings, pairing, key searches by shortlist, dependencies and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import keys, observe, pairing, sniff, spelling
from ..sources import strict
from ..written import scratch
from . import derive as D
from .overview import overview

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# ---- strict CSV: orders as text, with quoted line feeds and delimiters, rows that are too wide and too short

_KINDS = (17, 29, 31)


def _written(s: SparkSession, d: str) -> strict.Strict:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    note = F.when(k % 17 == 0, F.concat(F.lit('"two'), F.lit("\n"), F.lit('lines, ""'), k.cast("string"), F.lit('"""'))).otherwise(F.col("o_orderstatus"))
    row = F.when(k % 29 == 0, F.concat_ws(",", k, F.replace(price, F.lit("."), F.lit(",")), note, day)).when(k % 31 == 0, F.concat_ws(",", k, price)).otherwise(F.concat_ws(",", k, price, note, day))
    path = scratch(s, "csv")
    header = s.createDataFrame([("key,price,note,day",)], "value string")
    # every file is one with a header of its own: the header goes before the rows of each task
    rows = D.table(s, d, "orders").select(row.alias("value"))
    header.coalesce(1).write.text(path + "/head")
    rows.write.text(path + "/rows")
    return strict.read_strict(s, [path + "/head", path + "/rows"], header_in=path + "/head")


_CSV = """WITH t AS (SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,2)::VARCHAR AS price, CASE WHEN o_orderkey % 17 = 0 THEN 'two' || chr(10) || 'lines, "' || o_orderkey || '"' ELSE o_orderstatus END AS note, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""


@query(_CSV + " SELECT k::VARCHAR AS key, price, CASE WHEN k % 31 <> 0 THEN note END AS note, CASE WHEN k % 31 <> 0 THEN day END AS day FROM t WHERE k % 29 <> 0")
def csv_strict_rows(s, d):
    return _written(s, d).rows


@query(_CSV + """ SELECT 5 AS width, k || ',' || replace(price, '.', ',') || ',' || CASE WHEN k % 17 = 0 THEN '"two' || chr(10) || 'lines, ""' || k || '""' || '"' ELSE note END || ',' || day AS raw, 'more fields than the header' AS problem FROM t WHERE k % 29 = 0""")
def csv_set_aside(s, d):
    return _written(s, d).set_aside.select("width", "raw", "problem")


@query(_CSV + " SELECT CASE WHEN k % 29 = 0 THEN 5 WHEN k % 31 = 0 THEN 2 ELSE 4 END AS width, count(*) AS n FROM t GROUP BY 1")
def csv_widths(s, d):
    return _written(s, d).widths


# ---- spellings


def _misspelt(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("p_partkey") % 5, F.col("p_type")
    return D.table(s, d, "part").select(F.when(k == 0, F.upper(t)).when(k == 1, F.concat(t, F.lit("S"))).when(k == 2, F.concat(F.lit("THE "), t)).otherwise(t).alias("value"))


_GRAMS = """g AS (SELECT *, list_sort(list_distinct(list_transform(range(1, greatest(length(value) - 2, 1) + 1), lambda i: substr(lower(value), i, 3)))) AS g FROM c)"""


@query("""WITH v AS (SELECT CASE p_partkey % 5 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type || 'S' WHEN 2 THEN 'THE ' || p_type ELSE p_type END AS value FROM part), c AS (SELECT value, count(*) AS n FROM v GROUP BY 1),
""" + _GRAMS + """, x AS (SELECT a.value AS a, b.value AS b, len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS alike FROM g a JOIN g b ON a.value < b.value)
SELECT a, b, round(alike, 6) AS alike FROM x WHERE alike >= 0.5""")
def spell_alike_pairs(s, d):
    v = spelling.counts(_misspelt(s, d), "value").withColumn("g", spelling.grams(F.col("value"))).withColumn("rank", F.struct("value"))
    return spelling.alike_pairs(v, 0.5).select(F.col("a.value").alias("a"), F.col("b.value").alias("b"), F.round("alike", 6).alias("alike"))


@query("""WITH RECURSIVE v AS (SELECT CASE p_partkey % 5 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type || 'S' WHEN 2 THEN 'THE ' || p_type ELSE p_type END AS value FROM part), c AS (SELECT value, count(*) AS n FROM v GROUP BY 1),
""" + _GRAMS + """, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS i FROM g),
x AS (SELECT a.i AS a, b.i AS b FROM r a JOIN r b ON a.i < b.i AND len(list_intersect(a.g, b.g)) * 3 >= len(a.g) + len(b.g)),
h(i, heads) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT h.i + 1, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.b = h.i + 1 AND list_contains(h.heads, x.a)) THEN h.heads ELSE list_append(h.heads, h.i + 1) END FROM h WHERE h.i < (SELECT count(*) FROM r)),
f AS (SELECT heads FROM h ORDER BY i DESC LIMIT 1), m AS (SELECT r.i, CASE WHEN list_contains(heads, r.i) THEN r.i ELSE (SELECT min(x.a) FROM x WHERE x.b = r.i AND list_contains(heads, x.a)) END AS head FROM r, f)
SELECT h.value AS head, r.value, r.n FROM m JOIN r USING (i) JOIN r h ON h.i = m.head WHERE m.head IN (SELECT head FROM m GROUP BY 1 HAVING count(*) > 1)""")
def spell_gram_groups(s, d):
    return spelling.gram_groups(_misspelt(s, d), "value").drop("alike")


# ---- columns of two tables paired by what is in them


@query("""WITH l AS (SELECT 'c_custkey' AS c, c_custkey::VARCHAR AS v FROM customer UNION SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION SELECT 'c_mktsegment', lower(trim(c_mktsegment)) FROM customer),
r AS (SELECT 'buyer' AS c, o_custkey::VARCHAR AS v FROM orders UNION SELECT 'place', (o_orderkey % 25)::VARCHAR FROM orders UNION SELECT 'word', lower(trim(o_orderpriority)) FROM orders),
ln AS (SELECT c, count(*) AS n FROM l GROUP BY 1), rn AS (SELECT c, count(*) AS n FROM r GROUP BY 1), b AS (SELECT l.c AS a, r.c AS b, count(*) AS n FROM l JOIN r USING (v) GROUP BY 1, 2)
SELECT a, b, ln.n AS a_values, rn.n AS b_values, round(b.n / least(ln.n, rn.n), 6) AS containment, round(b.n::DOUBLE / (ln.n + rn.n - b.n), 6) AS jaccard FROM b JOIN ln ON ln.c = a JOIN rn ON rn.c = b""")
def pair_shared_values(s, d):
    o = D.table(s, d, "orders").select(F.col("o_custkey").alias("buyer"), (F.col("o_orderkey") % 25).alias("place"), F.col("o_orderpriority").alias("word"))
    out = pairing.shared_values(D.table(s, d, "customer"), o, ["c_custkey", "c_nationkey", "c_mktsegment"], ["buyer", "place", "word"], keep=1_000_000)
    return out.withColumns({c: F.round(c, 6) for c in ("containment", "jaccard")})


# ---- keys


def _digits_of_a_key(s: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    once = D.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("qty"), F.min("l_returnflag").alias("flag"))
    return once.select((k % 97).alias("place_id"), (F.floor(k / 97) % 101).alias("page_id"), F.floor(k / 9797).alias("book_id"), "qty", "flag")


_K = ("place_id", "page_id", "book_id", "flag", "qty")
_SETS = [c for n in (1, 2, 3) for c in __import__("itertools").combinations(_K, n)]


@query("""WITH u AS (SELECT l_orderkey * 8 + l_linenumber AS k, min(l_quantity) AS qty, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber), t AS (SELECT k % 97 AS place_id, (k // 97) % 101 AS page_id, k // 9797 AS book_id, qty, flag FROM u),
c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{','.join(sorted(c))}', {len(c)}, (SELECT count(DISTINCT ({', '.join(c)},)) FROM t))" for c in _SETS) + """) v(columns, width, n))
SELECT columns, n AS distinct_values FROM c WHERE n = (SELECT count(*) FROM t) AND width = (SELECT min(width) FROM c WHERE n = (SELECT count(*) FROM t))""")
def key_shortlist(s, d):
    found = keys.shortlist(_digits_of_a_key(s, d).select(*_K))
    least = min((len(c.columns) for c in found), default=0)
    return s.createDataFrame([(",".join(sorted(c.columns)), c.distinct) for c in found if len(c.columns) == least], "columns string, distinct_values long")


_FIX = "WITH l AS (SELECT DISTINCT 'EMP-' || lpad(c_custkey::VARCHAR, 8, '0') || '/x' AS v FROM customer), r AS (SELECT DISTINCT c_custkey::VARCHAR AS v FROM customer)"
_TRIED = {
    "as written": ("v", "v"), "prefix EMP- on a": ("regexp_replace(v, '^EMP-', '')", "v"), "suffix /x on a": ("regexp_replace(v, '/x$', '')", "v"),
    "prefix EMP- on a and leading zeros": ("ltrim(regexp_replace(v, '^EMP-', ''), '0')", "ltrim(v, '0')"), "digits": ("regexp_replace(v, '[^0-9]', '', 'g')", "regexp_replace(v, '[^0-9]', '', 'g')"),
}


@query(_FIX + ", x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS fix, (SELECT count(DISTINCT {a}) FROM l) AS left_values, (SELECT count(DISTINCT {b}) FROM r) AS right_values, (SELECT count(*) FROM (SELECT DISTINCT {a} AS v FROM l) JOIN (SELECT DISTINCT {b} AS v FROM r) USING (v)) AS met" for n, (a, b) in _TRIED.items()) + ") SELECT * FROM x")
def key_format_shares(s, d):
    k = F.col("c_custkey").cast("string")
    c = D.table(s, d, "customer").select(F.concat(F.lit("EMP-"), F.lpad(k, 8, "0"), F.lit("/x")).alias("a"), k.alias("b"))
    return keys.fix_shares(c, c, "a", "b").filter(F.col("fix").isin(*_TRIED)).select("fix", "left_values", "right_values", "met")


@query("""WITH v AS (SELECT 'a' AS side, 'ID ' || c_custkey || ' eur' AS v FROM customer UNION SELECT 'b', c_custkey || ' eur' FROM customer), p AS (SELECT side, 'prefix' AS place, regexp_extract(v, '^[^0-9]+') AS run, v FROM v UNION ALL SELECT side, 'suffix', regexp_extract(v, '[^0-9]+$'), v FROM v),
n AS (SELECT side, place, run, count(*) AS n FROM p WHERE run <> '' GROUP BY ALL), t AS (SELECT side, count(*) AS total FROM v GROUP BY 1)
SELECT n.side, n.place, n.run FROM n JOIN t USING (side) WHERE n.n >= 0.9 * total AND (SELECT count(*) FROM v o WHERE o.side <> n.side AND CASE n.place WHEN 'prefix' THEN starts_with(o.v, n.run) ELSE ends_with(o.v, n.run) END) <= 0.1 * (SELECT o.total FROM t o WHERE o.side <> n.side)""")
def key_affixes(s, d):
    k = F.col("c_custkey").cast("string")
    c = D.table(s, d, "customer").select(F.concat(F.lit("ID "), k, F.lit(" eur")).alias("a"), F.concat(k, F.lit(" eur")).alias("b"))
    return s.createDataFrame(keys.affixes(c, c, "a", "b"), "side string, place string, run string")


# ---- dependencies of a whole table

_LINE = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", "month", "half", "flag_no"]
_LINE_T = "t AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS month, year(l_shipdate) * 10 + CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END AS half, ascii(l_returnflag) AS flag_no FROM lineitem)"


@query(f"WITH {_LINE_T}, d AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', (SELECT count(DISTINCT {c}) FROM t))" for c in _LINE) + ") v(c, n)), p AS (" + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT {y}) AS n FROM t GROUP BY {x})) AS held" for x in _LINE for y in _LINE if x != y) + """)
SELECT a, b FROM p JOIN d x ON x.c = a JOIN d y ON y.c = b WHERE held AND x.n > 1 AND y.n > 1 AND x.n < 0.99 * (SELECT count(*) FROM t)""")
def obs_dependencies_lines(s, d):
    day = F.col("l_shipdate")
    t = D.table(s, d, "lineitem").withColumns({"month": F.date_format(day, "yyyy-MM"), "half": F.year(day) * 10 + (F.month(day) > 6).cast("int"), "flag_no": F.ascii("l_returnflag")})
    return s.createDataFrame(observe.dependencies(t, _LINE), "a string, b string")


# ---- casts by form

_MIXED = """t AS (SELECT CASE WHEN o_orderkey % 10 < 7 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN o_orderkey % 10 < 9 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'open' END AS day,
 CASE WHEN o_orderkey % 4 = 0 THEN format('{:,}', o_totalprice::BIGINT) WHEN o_orderkey % 4 = 1 THEN '' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS amount FROM orders)"""


@query(f"""WITH {_MIXED}, n AS (SELECT nullif(amount, '') AS v FROM t), a AS (SELECT 'amount' AS column_name, 'number' AS kind, count(v) AS filled, count(v) AS reads, 'with , removed' AS form, count(v) AS n,
 max(length(split_part(replace(v, ',', ''), '.', 1)))::INTEGER AS before, max(length(split_part(replace(v, ',', ''), '.', 2)))::INTEGER AS after FROM n)
SELECT * FROM a UNION ALL SELECT 'day', 'date', count(*), count(*) FILTER (day <> 'open'), '%d.%m.%Y', count(try_strptime(day, '%d.%m.%Y')), 0, 0 FROM t""")
def sniff_casts(s, d):
    k, day, price = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_totalprice")
    t = D.table(s, d, "orders").select(
        F.when(k % 10 < 7, F.date_format(day, "dd.MM.yyyy")).when(k % 10 < 9, F.date_format(day, "yyyy/MM/dd")).otherwise("open").alias("day"),
        F.when(k % 4 == 0, F.format_number(F.round(price).cast("long"), 0)).when(k % 4 == 1, "").otherwise(price.cast("decimal(18,2)").cast("string")).alias("amount"),
    )
    return sniff.casts(t, ["day", "amount"]).na.fill(0, ["before", "after"])


# ---- the overview

_OV = """t AS (SELECT c_custkey + CASE WHEN c_custkey > 100 THEN 40 ELSE 0 END AS k, CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 50 ELSE c_acctbal END AS balance, c_nationkey AS nation, c_nationkey % 5 AS region FROM customer)"""
_OVP = " UNION ALL ".join(f"SELECT '{x}' AS value, '{y}' AS column_name, count(*)::DOUBLE AS n, count(DISTINCT coalesce({x}::VARCHAR, '?'))::DOUBLE AS dx, count(DISTINCT coalesce({y}::VARCHAR, '?'))::DOUBLE AS dy, count(DISTINCT (coalesce({x}::VARCHAR, '?'), coalesce({y}::VARCHAR, '?')))::DOUBLE AS dxy FROM t" for x in ("segment", "balance", "nation", "region") for y in ("segment", "balance", "nation", "region") if x != y)


@query(f"""WITH {_OV}, p AS ({_OVP}), c AS (SELECT *, 1 / (dy * (1 - pow(1 - 1 / dy, n / dx))) AS chance FROM p), s AS (SELECT value, column_name, CASE WHEN chance >= 1 THEN 0 ELSE round(greatest(0, (dx / dxy - chance) / (1 - chance)) * 100, 2) END AS score FROM c),
q AS (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM t), r AS (SELECT quantile_cont(nation, 0.25) AS a, quantile_cont(nation, 0.75) AS b FROM t)
SELECT 'placeholder' AS finding, 'segment' AS column_name, 'n/a' AS value, count(*)::DOUBLE AS n FROM t WHERE segment = 'N/A'
UNION ALL SELECT 'spelled several ways', 'segment', arg_max(segment, (n, segment)), count(*)::DOUBLE FROM (SELECT segment, count(*) AS n FROM t GROUP BY 1) GROUP BY lower(segment) HAVING count(*) > 1
UNION ALL SELECT 'gap', 'k', '101 - 140', 40
UNION ALL SELECT 'outliers', 'balance', NULL, count(*)::DOUBLE FROM t, q WHERE balance < a - 1.5 * (b - a) OR balance > b + 1.5 * (b - a) HAVING count(*) > 0
UNION ALL SELECT 'outliers', 'nation', NULL, count(*)::DOUBLE FROM t, r WHERE nation < a - 1.5 * (b - a) OR nation > b + 1.5 * (b - a) HAVING count(*) > 0
UNION ALL SELECT * FROM (SELECT 'pair', column_name, value, score FROM s WHERE score > 0 ORDER BY score DESC, value, column_name LIMIT 5)""")
def prof_overview(s, d):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    t = D.table(s, d, "customer").select(
        (k + F.when(k > 100, 40).otherwise(0)).alias("k"), F.when(k % 9 == 0, "N/A").when(k % 2 == 0, F.lower(m)).otherwise(m).alias("segment"),
        F.when(k % 97 == 0, F.col("c_acctbal") * 50).otherwise(F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"), (F.col("c_nationkey") % 5).alias("region"),
    )
    return overview(t, texts=["segment"], numbers=["balance", "nation", "region"], key="k")
