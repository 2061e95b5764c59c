"""Comparison and read-back queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import predicates as P
from ..operators import diff, match, profile, readback
from ..operators.diff import Options, Rule
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


def pairs(s: SparkSession, d: str) -> DataFrame:
    return match.keyed(D.left(s, d), D.right(s, d), ["o_orderkey"], [], "unique")


def line_pairs(s: SparkSession, d: str, how: str = "index") -> DataFrame:
    return match.keyed(D.line_left(s, d), D.line_right(s, d), D.LINE_KEYS, D.LINE_ORDER.split(", "), how)


C = D.COLUMNS
_J = D.SIDES + ", j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS k, l, r FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey)"


def _cells(same: dict[str, str] | None = None) -> str:
    test = lambda c: (same or {}).get(c, f"l.{c} IS NOT DISTINCT FROM r.{c}")
    return ", cells AS (" + " UNION ALL ".join(f"SELECT l.o_orderkey AS o_orderkey, '{c}' AS column_name, l.{c} AS left_value, r.{c} AS right_value FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE NOT coalesce({test(c)}, false)" for c in C) + ")"


_CELLS = D.SIDES + _cells()


@query(_CELLS + " SELECT * FROM cells")
def cmp_key_cells(s, d):
    return diff.cells(pairs(s, d), ["o_orderkey"], C)


@query(_CELLS + """ SELECT (SELECT count(*) FROM l JOIN r USING (o_orderkey)) AS matched, (SELECT count(*) FROM l ANTI JOIN r USING (o_orderkey)) AS only_left, (SELECT count(*) FROM r ANTI JOIN l USING (o_orderkey)) AS only_right,
  count(DISTINCT o_orderkey) AS diff_rows, count(*) AS cell_diffs, 0::BIGINT AS left_duplicates, 0::BIGINT AS right_duplicates FROM cells""")
def cmp_key_summary(s, d):
    return diff.summary(pairs(s, d), C)


@query(D.SIDES + " SELECT l.* FROM l ANTI JOIN r USING (o_orderkey)")
def cmp_left_only(s, d):
    return diff.one_sided(pairs(s, d), "l")


@query(D.SIDES + " SELECT r.* FROM r ANTI JOIN l USING (o_orderkey)")
def cmp_right_only(s, d):
    return diff.one_sided(pairs(s, d), "r")


_OCC = D.LINE_SQL + f""", lo AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {D.LINE_ORDER}) AS occ FROM l),
ro AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {D.LINE_ORDER}) AS occ FROM r)"""
_LCELLS = lambda extra: ", cells AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, occ AS occurrence, '{c}' AS column_name, lo.{c} AS left_value, ro.{c} AS right_value FROM lo JOIN ro USING (l_orderkey, l_linenumber, occ) WHERE lo.{c} IS DISTINCT FROM ro.{c} {extra}" for c in D.LINE) + ")"


@query(_OCC + _LCELLS("") + " SELECT * FROM cells")
def cmp_dup_occurrence(s, d):
    return diff.cells(line_pairs(s, d), D.LINE_KEYS, D.LINE, occurrence=True)


@query(_OCC + _LCELLS("AND occ = 1") + " SELECT l_orderkey, l_linenumber, column_name, left_value, right_value FROM cells")
def cmp_dup_first(s, d):
    return diff.cells(line_pairs(s, d, "first"), D.LINE_KEYS, D.LINE)


@query(_OCC + _LCELLS("") + """ SELECT (SELECT count(*) FROM lo JOIN ro USING (l_orderkey, l_linenumber, occ)) AS matched, (SELECT count(*) FROM lo ANTI JOIN ro USING (l_orderkey, l_linenumber, occ)) AS only_left,
 (SELECT count(*) FROM ro ANTI JOIN lo USING (l_orderkey, l_linenumber, occ)) AS only_right, count(DISTINCT (l_orderkey, l_linenumber, occurrence)) AS diff_rows, count(*) AS cell_diffs,
 (SELECT count(*) FROM lo WHERE occ > 1) AS left_duplicates, (SELECT count(*) FROM ro WHERE occ > 1) AS right_duplicates FROM cells""")
def cmp_dup_summary(s, d):
    return diff.summary(line_pairs(s, d), D.LINE)


@query(D.SIDES + """ SELECT coalesce(l.o_orderkey, r.o_orderkey) AS pos, l.o_orderstatus AS left_status, r.o_orderstatus AS right_status FROM l FULL JOIN r USING (o_orderkey) WHERE l.o_orderstatus IS DISTINCT FROM r.o_orderstatus""")
def cmp_position(s, d):
    n = lambda df: df.withColumn("pos", F.col("o_orderkey"))  # noqa: E731  # numbers that the rows bring along
    m = match.positional(n(D.left(s, d)), n(D.right(s, d)), "pos")
    out = m.select("pos", F.col("l.o_orderstatus").alias("left_status"), F.col("r.o_orderstatus").alias("right_status"))
    return out.filter(~F.col("left_status").eqNullSafe(F.col("right_status")))


@query(D.SIDES + """, ln AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS pos FROM l), rn AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS pos FROM r)
SELECT coalesce(ln.pos, rn.pos) AS pos, ln.o_orderstatus AS left_status, rn.o_orderstatus AS right_status FROM ln FULL JOIN rn ON ln.pos = rn.pos WHERE ln.o_orderstatus IS DISTINCT FROM rn.o_orderstatus""")
def cmp_position_whole(s, d):
    n = lambda df: match.numbered(df.select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"), "pos")
    m = match.positional(n(D.left(s, d)), n(D.right(s, d)), "pos")
    out = m.select("pos", F.col("l.o_orderstatus").alias("left_status"), F.col("r.o_orderstatus").alias("right_status"))
    return out.filter(~F.col("left_status").eqNullSafe(F.col("right_status")))


_MS = ["o_orderstatus", "o_orderpriority", "o_orderdate"]
_MSQL = D.SIDES + f""", m AS (SELECT {', '.join(_MS)}, sum(a)::BIGINT AS left_count, sum(b)::BIGINT AS right_count FROM (SELECT {', '.join(_MS)}, 1 AS a, 0 AS b FROM l UNION ALL SELECT {', '.join(_MS)}, 0, 1 FROM r) GROUP BY {', '.join(_MS)})"""


@query(_MSQL + " SELECT * FROM m WHERE left_count <> right_count")
def cmp_multiset(s, d):
    return match.count_differences(D.left(s, d), D.right(s, d), _MS)


@query(_MSQL + " SELECT sum(least(left_count, right_count))::BIGINT AS matched, sum(greatest(left_count - right_count, 0))::BIGINT AS only_left, sum(greatest(right_count - left_count, 0))::BIGINT AS only_right FROM m")
def cmp_multiset_summary(s, d):
    return match.multiset_summary(D.left(s, d), D.right(s, d), _MS)


@query(_MSQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_MS)} ORDER BY o_orderkey) AS n FROM l)
SELECT k.* EXCLUDE (n) FROM k JOIN m ON {' AND '.join(f'k.{c} IS NOT DISTINCT FROM m.{c}' for c in _MS)} WHERE n > right_count""")
def cmp_hash_left(s, d):
    return match.whole_row(D.left(s, d), D.right(s, d), _MS, ["o_orderkey"])[0]


@query(D.SIDES + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(*) FROM (SELECT {c} FROM l WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM r)) + (SELECT count(*) FROM (SELECT {c} FROM r WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM l)) AS gaps" for c in C))
def cmp_value_gaps(s, d):
    return match.value_gaps(D.left(s, d), D.right(s, d), C)


@query(D.SIDES.replace("FROM orders", "FROM orders").replace("o_orderpriority FROM orders", "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders") + _cells({c: f"l.{c} = r.{c}" for c in C}) + " SELECT * FROM cells")
def cmp_nulls_differ(s, d):
    l = D.left(s, d).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")))
    r = D.right(s, d).withColumn("o_orderpriority", F.when((F.col("o_orderkey") % 17 != 0) | (F.col("o_orderkey") > 10_000_000), F.col("o_orderpriority")))
    return diff.cells(match.keyed(l, r, ["o_orderkey"], [], "unique"), ["o_orderkey"], C, Options(nulls_equal=False))


def _only(sql_same: str, column: str) -> str:
    return D.SIDES + _cells({column: sql_same}) + f" SELECT * FROM cells WHERE column_name = '{column}'"


@query(_only("abs(l.o_totalprice::DOUBLE - r.o_totalprice::DOUBLE) <= 0.5", "o_totalprice"))
def cmp_tolerance_abs(s, d):
    return diff.cells(pairs(s, d), ["o_orderkey"], ["o_totalprice"], Options(rules={"o_totalprice": Rule("number", tolerance=0.5)}))


@query(_only("abs(l.o_totalprice::DOUBLE - r.o_totalprice::DOUBLE) <= 0.00001 * greatest(abs(l.o_totalprice::DOUBLE), abs(r.o_totalprice::DOUBLE))", "o_totalprice"))
def cmp_tolerance_rel(s, d):
    return diff.cells(pairs(s, d), ["o_orderkey"], ["o_totalprice"], Options(rules={"o_totalprice": Rule("number", relative=0.00001)}))


@query(D.SIDES + _cells({c: f"lower(l.{c}) IS NOT DISTINCT FROM lower(r.{c})" for c in C}) + " SELECT * FROM cells")
def cmp_ignore_case(s, d):
    return diff.cells(pairs(s, d), ["o_orderkey"], C, Options(ignore_case=True))


@query(D.SIDES + " SELECT l.o_orderkey, 'o_orderdate' AS column_name, strftime(l.o_orderdate::DATE, '%d/%m/%Y') AS left_value, CASE WHEN o_orderkey % 19 = 0 THEN (r.o_orderdate::DATE + 1)::VARCHAR ELSE r.o_orderdate END AS right_value FROM l JOIN r USING (o_orderkey) WHERE o_orderkey % 19 = 0")
def cmp_date_rule(s, d):
    l = D.left(s, d).withColumn("o_orderdate", F.date_format(F.col("o_orderdate").cast("date"), "dd/MM/yyyy"))
    r = D.right(s, d).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 19 == 0, F.date_add(F.col("o_orderdate").cast("date"), 1).cast("string")).otherwise(F.col("o_orderdate")))
    return diff.cells(match.keyed(l, r, ["o_orderkey"], [], "unique"), ["o_orderkey"], ["o_orderdate"], Options(rules={"o_orderdate": Rule("date", left_formats=("%d/%m/%Y",))}))


@query(_CELLS + " SELECT column_name, count(*) AS cells FROM cells GROUP BY 1")
def cmp_diffs_by_column(s, d):
    return diff.by_column(cmp_key_cells(s, d))


@query(_CELLS + """, p AS (SELECT column_name, left_value, right_value, count(*) AS n FROM cells GROUP BY ALL),
q AS (SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY column_name), 2) AS percent, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, left_value NULLS LAST, right_value NULLS LAST) AS rank FROM p) SELECT * FROM q WHERE rank <= 10""")
def cmp_value_pairs_top(s, d):
    return readback.value_pairs(cmp_key_cells(s, d))


@query(_CELLS + """, c AS (SELECT l.o_orderstatus AS value, o_orderkey FROM l JOIN r USING (o_orderkey)), g AS (SELECT value, count(*) AS matched FROM c GROUP BY 1)
SELECT value, any_value(matched) AS matched, count(DISTINCT o_orderkey) AS diff_rows, count(*) AS cells, array_to_string(list_sort(list(DISTINCT column_name)), ',') AS columns, round(100.0::DOUBLE * count(DISTINCT o_orderkey) / any_value(matched), 2) AS percent
FROM cells JOIN c USING (o_orderkey) JOIN g USING (value) GROUP BY 1""")
def cmp_by_key_value(s, d):
    m = pairs(s, d).withColumn("status", F.col("l.o_orderstatus"))
    return readback.by_key_value(m, "status", C)


@query(_CELLS + " SELECT l.* FROM l SEMI JOIN r USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cells)")
def cmp_bucket_same(s, d):
    return readback.bucket(pairs(s, d), "same", C).select("l.*")


@query(_CELLS + """, f AS (SELECT r.o_orderstatus AS value, count(*) AS n FROM r WHERE o_orderkey IN (SELECT o_orderkey FROM cells) GROUP BY 1) SELECT value, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS percent FROM f ORDER BY n DESC, value NULLS LAST LIMIT 3""")
def cmp_bucket_differ_top(s, d):
    return readback.frequencies(readback.bucket(pairs(s, d), "differ", C), F.col("r.o_orderstatus"), 3)


_VC = D.SIDES + """, v AS (SELECT o_orderpriority AS value, sum(a)::BIGINT AS left_n, sum(b)::BIGINT AS right_n FROM (SELECT o_orderpriority, 1 AS a, 0 AS b FROM l UNION ALL SELECT o_orderpriority, 0, 1 FROM r) GROUP BY 1),
w AS (SELECT *, left_n + right_n AS n, row_number() OVER (ORDER BY left_n + right_n DESC, value NULLS LAST) AS rank, sum(left_n + right_n) OVER (ORDER BY left_n + right_n DESC, value NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM v)"""


@query(_VC + " SELECT * FROM w")
def cmp_value_counts_both(s, d):
    return readback.value_counts(pairs(s, d), "o_orderpriority")


@query(_VC + " SELECT * FROM w WHERE lower(value) LIKE '%e%' ORDER BY rank LIMIT 2 OFFSET 1")
def cmp_value_counts_page(s, d):
    return readback.page(readback.search(cmp_value_counts_both(s, d), "E"), ["rank"], 1, 2)


@query(D.SIDES + """, v AS (SELECT l.o_orderstatus AS value, r.o_orderstatus AS right_value, count(*) AS n FROM l JOIN r USING (o_orderkey) GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY n DESC, value NULLS LAST, right_value NULLS LAST) AS rank, sum(n) OVER (ORDER BY n DESC, value NULLS LAST, right_value NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM v""")
def cmp_value_counts_pair(s, d):
    return readback.value_counts(pairs(s, d), "o_orderstatus", "pair")


@query(_CELLS + """, e AS (SELECT column_name, levenshtein(coalesce(left_value, ''), coalesce(right_value, '')) AS d, greatest(length(coalesce(left_value, '')), length(coalesce(right_value, '')), 1) AS n FROM cells)
SELECT column_name, count(*) AS mismatches, round(avg(d), 4) AS mean_distance, round(100 * avg(1 - least(1.0::DOUBLE, d::DOUBLE / n)), 2) AS similarity FROM e GROUP BY 1""")
def cmp_near_match(s, d):
    return readback.near_match(cmp_key_cells(s, d))


@query(D.SIDES + """, o AS (SELECT r.* FROM r ANTI JOIN l USING (o_orderkey)), u AS (UNPIVOT (SELECT o_custkey, o_orderstatus, o_orderpriority FROM o) ON COLUMNS(*) INTO NAME column_name VALUE v)
SELECT column_name, count(*) AS rows, count(v) AS filled, count(DISTINCT v) AS distinct_values, count(DISTINCT v) = 1 AND count(v) = count(*) AS constant FROM u GROUP BY 1""")
def cmp_one_sided_columns(s, d):
    return readback.one_sided_columns(pairs(s, d), "r", ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query(_CELLS + ", n AS (SELECT count(*) AS matched FROM l JOIN r USING (o_orderkey)) SELECT c.column_name, count(x.column_name) AS mismatched, any_value(matched) AS matched, round(100.0::DOUBLE * (any_value(matched) - count(x.column_name)) / any_value(matched), 2) AS match_percent FROM (VALUES " + ", ".join(f"('{c}')" for c in C) + ") c(column_name) LEFT JOIN cells x USING (column_name), n GROUP BY 1")
def cmp_ledger(s, d):
    return readback.ledger(pairs(s, d), C)


def _all_follow_ups(m: DataFrame) -> DataFrame:
    """what, name, n: the counts that the follow-ups to one written match come to."""
    row = lambda what, name, df: df.select(F.lit(what).alias("what"), name.alias("name")).groupBy("what", "name").agg(F.count("*").alias("n"))
    cells = row("cell", F.col("column_name"), diff.cells(m, ["o_orderkey"], C))
    sides = [row(side, F.col("o_orderstatus"), diff.one_sided(m, side)) for side in ("l", "r")]
    paired = row("pair", F.col("a_o_orderpriority"), readback.paired_rows(m, ["o_orderkey"], C))
    same = row("same", F.col("l.o_orderstatus"), readback.bucket(m, "same", C))
    columns = readback.ledger(m, C).select(F.lit("column").alias("what"), F.col("column_name").alias("name"), F.col("mismatched").alias("n"))
    values = readback.value_counts(m, "o_orderstatus").select(F.lit("value").alias("what"), F.col("value").alias("name"), "n")
    return reduce(DataFrame.unionByName, [cells, *sides, paired, same, columns, values])


@query(_CELLS + """, a AS (SELECT 'cell' AS what, column_name AS name, count(*) AS n FROM cells GROUP BY ALL UNION ALL SELECT 'l', o_orderstatus, count(*) FROM l ANTI JOIN r USING (o_orderkey) GROUP BY ALL
UNION ALL SELECT 'r', o_orderstatus, count(*) FROM r ANTI JOIN l USING (o_orderkey) GROUP BY ALL UNION ALL SELECT 'pair', l.o_orderpriority, count(*) FROM l JOIN r USING (o_orderkey) GROUP BY ALL
UNION ALL SELECT 'same', l.o_orderstatus, count(*) FROM l SEMI JOIN r USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cells) GROUP BY ALL
UNION ALL SELECT 'column', c, (SELECT count(*) FROM cells WHERE column_name = c) FROM (VALUES """ + ", ".join(f"('{c}')" for c in C) + """) v(c)
UNION ALL SELECT 'value', s, count(*) FROM (SELECT o_orderstatus AS s FROM l UNION ALL SELECT o_orderstatus FROM r) GROUP BY ALL) SELECT * FROM a""")
def cmp_snapshot(s, d):
    return _all_follow_ups(diff.snapshot(pairs(s, d), C))


@query(_CELLS + ", n AS (SELECT o_orderkey, count(*)::INTEGER AS n FROM cells GROUP BY 1) SELECT * FROM n ORDER BY n DESC, o_orderkey LIMIT 25")
def cmp_worst_rows(s, d):
    return readback.page(readback.differing_rows(pairs(s, d), C).select("o_orderkey", "n"), [F.desc("n"), "o_orderkey"], 0, 25)


@query(D.SIDES + " SELECT l.o_orderkey, 1 AS __occ__, " + ", ".join(f"l.{c} AS a_{c}, r.{c} AS b_{c}" for c in C) + " FROM l JOIN r USING (o_orderkey)")
def cmp_paired_rows(s, d):
    return readback.paired_rows(pairs(s, d), ["o_orderkey"], C)


@query(D.SIDES + " SELECT * FROM l WHERE o_totalprice::DOUBLE BETWEEN 1000 AND 50000 AND o_orderdate::DATE >= DATE '1995-03-01'")
def filter_typed(s, d):
    return D.left(s, d).filter(P.every([P.parse("o_totalprice:number between 1000..50000"), P.parse("o_orderdate:date >= 01/03/1995")]))


@query(D.SIDES + " SELECT * FROM r WHERE o_orderpriority <> '1-URGENT' OR o_orderpriority IS NULL")
def filter_ne_keeps_null(s, d):
    return D.right(s, d).filter(P.compile(P.parse("o_orderpriority != 1-URGENT")))


@query(D.SIDES + " SELECT * FROM r WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def filter_side_not_in_drops_null(s, d):
    return D.right(s, d).filter(P.compile(P.parse("o_orderpriority not in (1-URGENT, 2-HIGH)"), null_keeping=False))


@query(D.SIDES + " SELECT * FROM r WHERE regexp_matches(o_orderpriority, '^[12]') AND o_orderstatus ILIKE 'f' AND o_orderpriority IS NOT NULL")
def filter_patterns(s, d):
    return D.right(s, d).filter(P.every([P.parse("o_orderpriority ~ ^[12]"), P.parse("o_orderstatus ilike f"), P.parse("o_orderpriority is not null")]))


@query(D.SIDES + " SELECT * FROM l WHERE lower(o_orderpriority) LIKE '%low%' AND o_totalprice::DOUBLE > 100000")
def filter_quick(s, d):
    return D.left(s, d).filter(P.quick("o_orderpriority", "contains", "LOW") & P.quick("o_totalprice", ">", 100000))


@query(D.SIDES + " SELECT 'l' AS side, count(o_totalprice) AS filled, round(quantile_cont(o_totalprice::DOUBLE, 0.5), 6) AS median FROM l UNION ALL SELECT 'r', count(o_totalprice), round(quantile_cont(o_totalprice::DOUBLE, 0.5), 6) FROM r")
def cmp_medians(s, d):
    return readback.medians(pairs(s, d), "o_totalprice")


@query(_CELLS + ", d AS (SELECT o_orderkey, array_to_string(list_sort(list(column_name)), ',') AS marks FROM cells GROUP BY 1) SELECT o_orderkey, 'A' AS side, " + ", ".join(f"l.{c}" for c in C) + ", marks FROM l JOIN d USING (o_orderkey) UNION ALL SELECT o_orderkey, 'B', " + ", ".join(f"r.{c}" for c in C) + ", marks FROM r JOIN d USING (o_orderkey)")
def cmp_above_below(s, d):
    out = readback.above_below(pairs(s, d), ["o_orderkey"], C)
    return out.select("o_orderkey", "side", *C, F.array_join(F.array_sort("marks"), ",").alias("marks"))


@query(_CELLS + ", d AS (SELECT o_orderkey, array_to_string(list_sort(list(column_name)), ',') AS marks FROM cells GROUP BY 1) SELECT o_orderkey, marks, l.o_totalprice AS left_price, r.o_totalprice AS right_price, l.o_orderdate AS day FROM d JOIN l USING (o_orderkey) JOIN r USING (o_orderkey) ORDER BY l.o_orderdate, o_orderkey LIMIT 200")
def cmp_report_rows(s, d):
    rows = readback.report_rows(diff.with_differences(pairs(s, d), C), ["l.o_orderdate", "o_orderkey"], 200)
    return rows.select("o_orderkey", "marks", F.col("l.o_totalprice").alias("left_price"), F.col("r.o_totalprice").alias("right_price"), F.col("l.o_orderdate").alias("day"))


_WRITTEN = D.SIDES + ", w AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN lpad(o_orderkey::VARCHAR, 10, '0') ELSE o_orderkey::VARCHAR END AS k FROM l)"


@query(_WRITTEN + """, v AS (SELECT o_orderkey::VARCHAR AS k FROM r), n AS (SELECT (SELECT count(*) FROM w JOIN v USING (k)) < 0.9 * least((SELECT count(*) FROM w), (SELECT count(*) FROM v)) AS poor)
SELECT side, key FROM (SELECT 'left' AS side, k AS key, row_number() OVER (ORDER BY k) AS i FROM w ANTI JOIN v USING (k) UNION ALL SELECT 'right', k, row_number() OVER (ORDER BY k) FROM v ANTI JOIN w USING (k)), n WHERE poor AND i <= 3""")
def cmp_unmatched_samples(s, d):
    k = F.col("o_orderkey").cast("string")
    l = D.left(s, d).select(F.when(F.col("o_orderkey") % 3 == 0, F.lpad(k, 10, "0")).otherwise(k).alias("k"))
    return readback.unmatched_samples(match.keyed(l, D.right(s, d).select(k.alias("k")), ["k"], [], "unique"), ["k"])


@query("""WITH t AS (SELECT c_name AS name, c_mktsegment AS segment FROM customer), u AS (SELECT upper(c_name) AS name, c_mktsegment AS segment FROM customer),
l AS (SELECT 'name' AS c, name AS v FROM t UNION SELECT 'segment', segment FROM t), r AS (SELECT 'name' AS c, name AS v FROM u UNION SELECT 'segment', segment FROM u),
x AS (SELECT c, (SELECT count(*) FROM l WHERE l.c = q.c) AS ln, (SELECT count(*) FROM r WHERE r.c = q.c) AS rn, (SELECT count(*) FROM l JOIN r USING (c, v) WHERE l.c = q.c) AS b,
 (SELECT count(DISTINCT upper(v)) FROM l WHERE l.c = q.c) AS lu, (SELECT count(DISTINCT upper(v)) FROM r WHERE r.c = q.c) AS ru, (SELECT count(DISTINCT upper(l.v)) FROM l JOIN r ON l.c = r.c AND upper(l.v) = upper(r.v) WHERE l.c = q.c) AS ub FROM (VALUES ('name'), ('segment')) q(c))
SELECT c AS column_name, round(b / least(ln, rn), 4) AS exact, round(ub / least(lu, ru), 4) AS folded, ub / least(lu, ru) >= 0.8 AND ub / least(lu, ru) - b / least(ln, rn) >= 0.3 AS ignore_case FROM x WHERE least(ln, rn) >= 5""")
def cmp_case_probe(s, d):
    t = D.table(s, d, "customer")
    name = lambda x: t.select(x.alias("name"), F.col("c_mktsegment").alias("segment"))
    return readback.case_probe(name(F.col("c_name")), name(F.upper("c_name")), ["name", "segment"])


@query(D.SIDES + ", v AS (SELECT 'l' AS side, o_totalprice::DOUBLE AS x FROM l UNION ALL SELECT 'r', o_totalprice::DOUBLE FROM r), e AS (SELECT side, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1), b AS (SELECT side, least(floor((x - lo) / ((hi - lo) / 12)), 11)::INTEGER AS bin, lo, hi FROM v JOIN e USING (side) WHERE x IS NOT NULL) "
       "SELECT side, bin, lo + bin * ((hi - lo) / 12) AS low, CASE WHEN bin = 11 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 12) END AS high, count(*) AS n FROM b GROUP BY side, bin, lo, hi")  # fmt: skip
def cmp_side_histogram(s, d):
    return readback.side_histogram(pairs(s, d), "o_totalprice", 12)


_BOTH = ", ".join(f"{tag}.{f} AS {side}_{f}" for tag, side in (("a", "left"), ("b", "right")) for f in ("null_percent", "distinct_values", "min_text", "max_text", "min_number", "max_number"))
_SIDE = lambda t: " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_percent, count(DISTINCT {c}) AS distinct_values, min({c}) AS min_text, max({c}) AS max_text, {f'min({c}::DOUBLE)' if c == 'o_totalprice' else 'NULL::DOUBLE'} AS min_number, {f'max({c}::DOUBLE)' if c == 'o_totalprice' else 'NULL::DOUBLE'} AS max_number FROM {t}" for c in C)


@query(D.SIDES + f", a AS ({_SIDE('l')}), b AS ({_SIDE('r')}) SELECT a.column_name, {_BOTH}, round(abs(a.null_percent - b.null_percent), 2) AS null_gap FROM a JOIN b USING (column_name)")
def cmp_both_sides(s, d):
    return profile.both_sides(D.left(s, d), D.right(s, d), C, ["o_totalprice"])


_PAIR_COLUMNS = ", ".join(f"l.{c} AS a_{c}, r.{c} AS b_{c}" for c in C)
_DIFFER = " OR ".join(f"l.{c} IS DISTINCT FROM r.{c}" for c in C)


@query(D.SIDES + f" SELECT l.o_orderkey, {_PAIR_COLUMNS} FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE {_DIFFER}")
def cmp_bucket_rows(s, d):
    return readback.bucket_rows(pairs(s, d), "differ", ["o_orderkey"], C)


_BUCKET_TOP = " UNION ALL ".join(f"(SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM b GROUP BY 2 ORDER BY n DESC, value NULLS LAST LIMIT 3)" for c in ("a_o_orderpriority", "b_o_orderpriority"))


@query(D.SIDES + f""", b AS (SELECT l.o_orderkey, {_PAIR_COLUMNS} FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE {_DIFFER})
SELECT *, round(100.0::DOUBLE * n / (SELECT count(*) FROM b), 2) AS percent, (row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS LAST))::INTEGER AS rank FROM ({_BUCKET_TOP})""")
def cmp_bucket_profile(s, d):
    rows = readback.bucket_rows(pairs(s, d), "differ", ["o_orderkey"], C)
    return profile.top_values(rows, ["a_o_orderpriority", "b_o_orderpriority"], 3)


_ONE_SIDE = lambda name, own, other: f"SELECT '{name}' AS side, (SELECT count(*) FROM {own}) AS rows, (SELECT count(*) FROM l JOIN r USING (o_orderkey)) AS matched, count(*) AS only, count(*) AS filled, min(o_orderkey)::VARCHAR AS lowest, max(o_orderkey)::VARCHAR AS highest FROM {own} ANTI JOIN {other} USING (o_orderkey)"


@query(D.SIDES + " " + _ONE_SIDE("A", "l", "r") + " UNION ALL " + _ONE_SIDE("B", "r", "l"))
def cmp_key_compare(s, d):
    return readback.key_compare(pairs(s, d), "o_orderkey")


@query("SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%m/%d/%Y') AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-02-03' AND DATE '1996-11-04' AND o_totalprice > 1500.5")
def filter_side_format(s, d):
    t = D.table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), F.col("o_totalprice").cast("string").alias("price"))
    asked = [P.parse(x) for x in ("day:date between 1995-02-03..1996-11-04", "price:number > 1500.5")]
    return t.filter(P.every(asked, formats={"day": ["%m/%d/%Y"]})).select("o_orderkey", "day")
