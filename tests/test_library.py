"""Planted small tables for what the registered queries don't reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates, predicates as P, values as V
from plumbline.operators import auto, diff, keys, match, notes, observe, pairing, profile, readback, sniff, spelling
from plumbline.plans import cli, outputs, profile_run
from plumbline.sources import guard, load, strict
from plumbline.sources.load import Source


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("1234.50", "1234.5"), ("007", "7"), ("1e3", "1000"), ("abc", "abc"), (".5", "0.5"), ("-0.0", "0"), ("1d", "1d"), ("12345678901234567890.1", "12345678901234567890.1"), ("1e30", "1e+30"), ("0.00000000012", "0.0000000001")])
def test_numbers(spark, text, want):
    assert one(spark, V.canon_number(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("01/10/26 06:59:36", "2026-10-01"), ("31/12/99", "1999-12-31"), ("2026/11/03", "2026-11-03"), ("5-Mar-2024", "2024-03-05"), ("2024", "2024"), ("20240131", "2024-01-31"), ("9999-12-31 23:59:59", "9999-12-31")])
def test_dates(spark, text, want):
    assert one(spark, V.canon_date(F.lit(text))) == want


def test_steps_refuse_and_fill(spark):
    assert one(spark, V.apply_steps(F.lit(" \u00a0"), [("if_empty", "0")])) == "0"
    assert one(spark, V.apply_steps(F.lit("ab"), [("expression", "concat(x, x)")])) == "abab"
    for bad in [("replace", ""), ("expression", "1; 2"), ("nothing",)]:
        with pytest.raises(ValueError):
            V.apply_steps(F.lit("a"), [bad])


def test_formats():
    assert dates.java_pattern("%d/%m/%Y %H:%M") == "d/M/y H:m"
    with pytest.raises(ValueError):
        dates.java_pattern("%Q")


def sides(spark):
    l = spark.createDataFrame([("1", "a", "10"), ("2", None, "20"), (None, "n", "1"), ("3", "c", "30"), ("3", "d", "31")], "id string, v string, w string")
    r = spark.createDataFrame([("1", "A", "10.0"), ("2", None, "21"), (None, "n", "1"), ("3", "c", "30"), ("4", "z", "0")], "id string, v string, w string")
    return l, r


@pytest.mark.parametrize("how,counts", [("index", (4, 1, 1)), ("first", (4, 0, 1))])
def test_keyed_match(spark, how, counts):
    l, r = sides(spark)
    s = diff.summary(match.keyed(l, r, ["id"], ["v"], how), ["v", "w"]).first()
    assert (s["matched"], s["only_left"], s["only_right"]) == counts
    with pytest.raises(match.DuplicateKeys):
        match.keyed(l, r, ["id"], [], "error")


def test_rules_and_symmetry(spark):
    l, r = sides(spark)
    m = match.keyed(l, r, ["id"], ["v"])
    number = diff.Options(ignore_case=True, rules={"w": diff.Rule("number")})
    assert [(c["id"], c["column_name"]) for c in diff.cells(m, ["id"], ["v", "w"], number).collect()] == [("2", "w")]
    strictly = diff.Options(nulls_equal=False)
    assert ("2", "v") in {(c["id"], c["column_name"]) for c in diff.cells(m, ["id"], ["v", "w"], strictly).collect()}
    a, b = diff.summary(m, ["v", "w"]).first(), diff.summary(match.keyed(r, l, ["id"], ["v"]), ["v", "w"]).first()
    assert (a["matched"], a["only_left"], a["only_right"], a["cell_diffs"]) == (b["matched"], b["only_right"], b["only_left"], b["cell_diffs"])
    same = diff.summary(match.keyed(l, l, ["id"], ["v"]), ["v", "w"]).first()
    assert same["cell_diffs"] == same["only_left"] == same["only_right"] == 0 and same["matched"] == 5


def test_buckets_part_matched(spark):
    m = match.keyed(*sides(spark), ["id"], ["v"])
    n = {b: readback.bucket(m, b, ["v", "w"]).count() for b in readback.BUCKETS}
    assert n["same"] + n["differ"] == n["matched"] and n["left"] == n["right"] == 1


def test_verdict_and_percent():
    assert diff.verdict(100, 0, 0, 0) == "Identical" and diff.verdict(100, 1, 0, 4) == "Small differences" and diff.verdict(0, 1, 1, 0) == "Differences"
    assert outputs.percent_text(1, 3) == "33.33" and outputs.percent_text(1, 10**6) == "0.0001" and outputs.percent_text(10**6 - 1, 10**6) == "99.9999"


def test_filters(spark):
    df = spark.createDataFrame([("1", "a"), ("9", "b"), ("10", None), ("100", "A b")], "id string, v string")
    count = lambda t, keep=True: df.filter(P.compile(P.parse(t), keep)).count()
    assert count("id:number > 9") == 2 and count("v != a") == 3 and count("v != a", False) == 2 and count("v is null") == 1 and count("v not like a%") == 3 and count("id in (1, 9)") == 2
    with pytest.raises(ValueError):
        P.parse("nothing here")


def test_minimal_key(spark):
    df = spark.createDataFrame([(i % 5, i % 10, i // 10) for i in range(100)], "grp_id int, a int, b int")
    assert [c.columns for c in keys.search(df)] == [("a", "b")]
    runs = spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 6, 20, 21, 22, 30, 32)], "id int")
    assert [tuple(r) for r in keys.gaps(runs, F.col("id")).limit(2).collect()] == [(7, 19, 13), (23, 29, 7)]
    assert keys.next_key(spark.createDataFrame([("AB0007",), ("X0012",)], "k string"), "k") == "X0013"
    padded = spark.createDataFrame([(f"{i:05d}", str(i)) for i in range(1, 41)], "a string, b string")
    assert keys.format_fix(padded, padded, "a", "b")[0] == "strip leading zeros"


def test_dependencies_and_spelling(spark):
    df = spark.createDataFrame([(i % 8, i % 4, i) for i in range(200)], "dept int, cost int, n int")
    assert ("dept", "cost") in observe.dependencies(df, ["dept", "cost", "n"]) and ("cost", "dept") not in observe.dependencies(df, ["dept", "cost", "n"])
    scores = {(a, b): s for a, b, s in observe.dependency_matrix(df, ["dept", "cost"])}
    assert scores["dept", "cost"] == 100 and scores["cost", "dept"] < 60
    grams = spark.createDataFrame([("abcdef",)] * 5 + [("abcdeg",)] * 3 + [("abcdhg",)] * 2 + [("zzzz",)], "v string")
    assert sorted((r["head"], r["value"]) for r in spelling.gram_groups(grams, "v").collect()) == [("abcdef", "abcdef"), ("abcdef", "abcdeg")]


@pytest.mark.parametrize("block", [2, 256])
def test_gram_groups_equal_one_loop(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "BLOCKS", 2)
    rng = random.Random(9)
    rows = [("".join(rng.choices("abAB", k=rng.randint(1, 7))),) for _ in range(150)] + [("",), (None,), ("x" * 61,)]
    df = spark.createDataFrame(rows, "v string")
    n = {}
    for (v,) in rows:
        if v is not None and len(v) <= 60:
            n[v] = n.get(v, 0) + 1
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))}
    heads, led = [], {}
    for v in sorted(n, key=lambda v: (-n[v], v)):
        g = grams(v.lower())
        led[v] = next((h for h in heads if len(grams(h.lower()) & g) * 2 >= len(grams(h.lower()) | g)), v)
        if led[v] == v:
            heads.append(v)
    want = sorted((h, v) for v, h in led.items() if list(led.values()).count(h) > 1)
    assert sorted((r["head"], r["value"]) for r in spelling.gram_groups(df, "v").collect()) == want


def test_sniff_pair_auto(spark):
    left = spark.createDataFrame([(f"E{i}", f"{i}.50", "Y" if i % 2 else "N", f"{1 + i % 28:02d}/03/2024") for i in range(60)], "emp_id string, salary string, active string, hired string")
    right = spark.createDataFrame([(f"E{i}", f"{i + (i == 7)}.5", "true" if i % 2 else "false", f"2024-03-{1 + i % 28:02d}") for i in range(5, 65)], "EmployeeId string, Salary string, Active string, Hired string")
    assert sniff.looks_like(left, left.columns) == {"emp_id": "text", "salary": "number", "active": "boolean", "hired": "date"}
    assert pairing.norm("Cost Center") == "cost_center"
    made, summary = auto.run(left, right.withColumn("EmployeeId", F.lower("EmployeeId")))
    row = summary.first()
    assert made.folded == ("emp_id",) and auto.plan(left, right).folded == ()
    assert made.key == ("emp_id",) and (row["matched"], row["only_left"], row["only_right"], row["cell_diffs"]) == (55, 5, 5, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,amt\n1,"x, y",5\n2,"he said ""no""",6\n3,"two\nlines",7\n')
    (tmp_path / "b.csv").write_text("id,name,amt\n1,a,2\n2,b,3,4\n3,c\n")
    (tmp_path / "c.jsonl").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": null}\n')
    rows = load.Source(f"{tmp_path}/a.csv").load(spark, number=True).orderBy("__rn__").collect()
    assert [r["name"] for r in rows] == ["x, y", 'he said "no"', "two\nlines"] and [r["__rn__"] for r in rows] == [1, 2, 3]
    assert load.Source(f"{tmp_path}/c.jsonl", where="v is null", derived={"d": "upper(id)"}).load(spark).first()["d"] == "2"
    s = strict.read_strict(spark, f"{tmp_path}/b.csv")
    assert s.rows.count() == 2 and s.set_aside.first()["width"] == 4 and {(r["width"], r["n"]) for r in s.widths.collect()} == {(2, 1), (3, 1), (4, 1)}
    assert load.short_header(["id", "", " name ", "id", "ID"]) == ["id", "column2", "name", "id_2", "ID_3"]
    assert load.pair_folders(["x/A.csv", "x/b.csv"], ["y/a.CSV"], "*.csv") == ([("x/A.csv", "y/a.CSV")], ["x/b.csv"], [])
    with pytest.raises(ValueError):
        load.kind_of("x.doc")


def test_strict_keeps_every_field(spark, tmp_path):
    (tmp_path / "w.csv").write_text('a,b,c\n1,,3,4\n5,"x, ""y""",7\n8\n9,,\n1,2,3,,,\n"open,2,3\n')
    s = strict.read_strict(spark, str(tmp_path / "w.csv"))
    assert sorted(tuple(r) for r in s.rows.collect()) == [("5", 'x, "y"', "7"), ("8", None, None), ("9", None, None)]
    assert [(r["record"], r["width"], r["raw"]) for r in s.page(0, 2).collect()] == [(1, 4, "1,,3,4"), (5, 6, "1,2,3,,,")]
    assert [r["problem"] for r in s.page(2, 5).collect()] == ["a quote is not closed"]
    assert strict.modal_width(s.widths) == 3 and len(s.messages()) == 5 and "decimal comma" in s.messages()[-2] and s.messages()[-1] == "line 7 opens a quote that never closes"


def test_strict_over_pieces_equals_one_reading(spark, tmp_path, monkeypatch):
    """Quoted line feeds, quotes across chunks, blank lines, skipped lines and several files, against a plain loop."""
    rng = random.Random(4)
    monkeypatch.setattr(strict, "CHUNK", 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    want = []
    try:
        for k in range(3):
            rows = ["a,b,c"]
            for i in range(200):
                cell = rng.choice(["x", '"p,q"', '"l\nm"', '"n\n\n,o"', '""', 'u"v,w"', ""])
                rows.append(rng.choice(["", f"{i},{cell},z", f"{i},{cell}", f"{i},{cell},z,12,5"]))
            text = "skipped\n" + "\n".join(rows) + "\n"
            (tmp_path / f"f{k}.csv").write_text(text)
            start, buf, record = 0, [], -1
            for n, line in enumerate(text.split("\n")[:-1], 1):
                if n == 1:
                    continue
                start = n if not buf else start
                buf.append(line)
                if "\n".join(buf).count('"') % 2 == 0:
                    raw = "\n".join(buf)
                    if raw:
                        record += 1
                        outside = "".join(raw.split('"')[::2])
                        want.append((f"f{k}.csv", start, record, len(buf), raw, outside.count(",") + 1))
                    buf = []
        got = strict.text_rows(spark, str(tmp_path), skip=1).collect()
        assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["record"], r["lines"], r["raw"]) for r in got) == sorted(w[:5] for w in want)
        s = strict.read_strict(spark, str(tmp_path), skip=1)
        assert sorted(r["line"] for r in s.set_aside.collect()) == sorted(w[1] for w in want if w[2] and w[5] > 3)
        assert s.rows.count() == sum(w[2] > 0 and w[5] <= 3 for w in want) and any("decimal comma" in m for m in s.messages())
        assert strict.read_strict(spark, str(tmp_path), skip=1, expected=5).set_aside.count() == sum(w[5] > 5 for w in want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_rows_kept_or_set_aside(spark, tmp_path):
    (tmp_path / "k.csv").write_text('made by hand\na,b\n1,"x\ny"\n2\n3,z,,w\nNA,q\n')
    path = str(tmp_path / "k.csv")
    kept = load.Source(path, skip_rows=1, bad_rows="keep", null_values=("NA",)).load(spark, number=True)
    assert kept.columns == ["a", "b", "column3", "column4", "__rn__"]
    assert sorted(kept.collect(), key=lambda r: r["__rn__"]) == [("1", "x\ny", None, None, 1), ("2", None, None, None, 2), ("3", "z", None, "w", 3), (None, "q", None, None, 4)]
    aside = load.Source(path, skip_rows=1, bad_rows="set_aside").load(spark, number=True)
    assert sorted(aside.collect(), key=lambda r: r["__rn__"]) == [("1", "x\ny", 1), ("2", None, 2), ("NA", "q", 4)]
    assert load.Source(path, skip_rows=2, header=False).read(spark).columns == ["column1", "column2", "column3", "column4"]
    (tmp_path / "o.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="line 2 opens a quote"):
        load.Source(str(tmp_path / "o.csv"), bad_rows="keep").read(spark)
    with pytest.raises(ValueError, match="neither"):
        load.Source(path, bad_rows="drop").read(spark)
    assert load.size_of(spark, str(tmp_path)) == sum(f.stat().st_size for f in tmp_path.iterdir())


def test_unique_match_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    with pytest.raises(Exception, match="more than once"):
        match.keyed(df, df.limit(1), ["id"], ["v"], "unique").collect()


def test_fixed_lists():
    from plumbline.functions import dates
    from plumbline.operators import keys, spelling

    assert len(dates.FALLBACK) == 16 and dates.FALLBACK[10] == "%m/%d/%Y" and dates.FALLBACK[-1] == "%b %d %Y"
    assert {"#n/a", "??", "not set"} <= set(spelling.PLACEHOLDERS) and "empty" not in spelling.PLACEHOLDERS
    assert "isin" in keys.ID_WORDS and "nav" in keys.MEASURE_WORDS and "etag" in keys.HASH_WORDS


def test_ranks_and_gaps_over_ranges(spark, monkeypatch):
    from plumbline.operators import keys, readback

    monkeypatch.setattr(keys, "RANGE", 10)
    numbers = [x for x in range(-500, 3000) if x % 97 and not 40 < x < 75] + [10**15, 10**15 + 1]
    df = spark.createDataFrame([(x,) for x in numbers], "x long")
    runs, want = sorted(tuple(r)[:2] for r in keys.islands(df, df["x"]).collect()), []
    for x in numbers:
        if want and want[-1][1] == x - 1:
            want[-1] = (want[-1][0], x)
        else:
            want.append((x, x))
    assert runs == want
    gaps = sorted(((b[0] - a[1] - 1, a[1] + 1, b[0] - 1) for a, b in zip(want, want[1:])), key=lambda g: (-g[0], g[1]))[:20]
    assert [(r["size"], r["low"], r["high"]) for r in keys.gaps(df, df["x"]).collect()] == gaps
    rows = [(f"v{i}" if i else None, 1 + i % 7) for i in range(200)]
    got = {r["value"]: (r["rank"], r["running"]) for r in readback.ranked(spark.createDataFrame(rows, "value string, n long"), ["value"]).collect()}
    total = 0
    for rank, (value, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or "")), 1):
        total += n
        assert got[value] == (rank, total)


def test_guard():
    assert guard.read_only("select 'drop' -- x\nfrom t;") == "select 'drop'  \nfrom t"
    for bad in ("drop table t", "select 1; select 2", "select * into x from t", "with a as (select 1) delete from t"):
        with pytest.raises(ValueError):
            guard.read_only(bad)
    for fine, dialect in (("SELECT replace(a, 'x', 'y') FROM t", None), ("select [drop], \"a;b\" from t where offset_set = 1", "mssql"), ("SELECT 'it''s; drop'", None), ("SELECT $t$ ; drop $t$", "postgresql"), ("SELECT q'[it's; drop]' FROM dual", "oracle"), (r"SELECT 'a\' AS b", "postgresql"), ("SELECT `drop` FROM t", "databricks")):
        assert guard.read_only(fine, dialect) == fine
    for bad, dialect in (("SELECT $$ ' $$; DROP TABLE t; --'", None), ("SELECT $$ ' $$; DROP TABLE t; --'", "postgresql"), (r"SELECT '\''; DROP TABLE t; --'", None), (r"SELECT '\''; DROP TABLE t; --'", "databricks"), (r"SELECT E'\''; DROP TABLE t; --'", "postgresql"), ("SELECT q'[']'; DROP TABLE t --]'", "oracle"), ("/* /* */ DROP */ SELECT 1", "mysql"), ("SELECT 1 --1; DROP TABLE t", "mysql"), ("SELECT /*! 1; DROP */ 1", "mysql"), ("SELECT 'a", "duckdb"), ("select [drop] from t", None)):
        with pytest.raises(ValueError):
            guard.read_only(bad, dialect)
    assert [guard.dialect_of(u) for u in ("jdbc:sqlserver://h", "jdbc:postgresql://h/d", "jdbc:other:x", "")] == ["mssql", "postgresql", None, None]
    assert guard.limited("WITH q AS (SELECT 1 a) SELECT * FROM q", 5, "mssql").startswith("WITH q")
    assert guard.limited("SELECT a FROM t", 5, "mssql") == "SELECT TOP 5 * FROM (SELECT a FROM t) q"
    assert guard.limited("select 1", 5, "oracle").endswith("FETCH FIRST 5 ROWS ONLY") and "***" in guard.redacted("jdbc:x://u:pw@h password=abc")


def test_config_run(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,v\n1,a\n2,b\n")
    (tmp_path / "r.csv").write_text("id,v\n1,a\n2,c\n3,d\n")
    config = {"left": {"path": f"{tmp_path}/l.csv"}, "right": {"path": f"{tmp_path}/r.csv"}, "keys": ["id"], "out": f"{tmp_path}/out"}
    assert cli.run(spark, config) == 1
    got = json.loads(next((tmp_path / "out" / "summary.json").glob("part*")).read_text())
    assert (got["matched"], got["only_right"], got["cell_diffs"], got["verdict"]) == (2, 1, 1, "Differences")
    assert cli.run(spark, config | {"pairs": [{"keys": ["no"]}]}) == 2
    assert cli.run(spark, config | {"right": config["left"]}) == 0
    (tmp_path / "x.csv").write_text("id,v,w\n1,a,1\n2,b,2\n")
    assert cli.run(spark, config | {"right": {"path": f"{tmp_path}/x.csv"}}) == 1  # a column on one side alone
    # a side's own filter of a column stands in for the common one
    keep = {"filters": {"both": ["v in (zz)"], "left": ["v in (a, b)"], "right": ["v in (a, c)"], "sql": {"right": "id < 3"}}}
    got = cli.compare(spark, config | keep).summary()
    assert (got["matched"], got["only_left"], got["only_right"]) == (2, 0, 0)


def test_folders_and_file_order(spark, tmp_path):
    for side, name, text in (("a", "One.csv", "id,v\n1,x\n1,b\n"), ("b", "one.csv", "id,v\n1,x\n1,b\n"), ("b", "two.csv", "id,v\n")):
        (tmp_path / side).mkdir(exist_ok=True)
        (tmp_path / side / name).write_text(text)
    config = {"folders": {"left": f"{tmp_path}/a", "right": f"{tmp_path}/b", "pattern": "*.csv"}, "keys": ["id"]}
    assert cli.run(spark, config) == 1  # two.csv has no counterpart
    assert cli.run(spark, config | {"folders": config["folders"] | {"pattern": "one*"}}) == 0
    pairs, alone = cli.folder_pairs(spark, config)
    assert len(pairs) == 1 and len(alone) == 1
    # duplicates pair in file order, not in the order of their values
    (tmp_path / "b" / "one.csv").write_text("id,v\n1,x\n1,c\n")
    result = cli.compare(spark, {"left": {"path": f"{tmp_path}/a/One.csv"}, "right": {"path": f"{tmp_path}/b/one.csv"}, "keys": ["id"]})
    assert result.summary()["cell_diffs"] == 1


def test_tied_pairs(spark):
    from plumbline.operators import keys

    df = spark.createDataFrame([(i, f"c{i % 40}", f"C{i % 40}", i // 40) for i in range(400)], "n int, a string, b string, c int")
    assert frozenset(("a", "b")) in keys.tied_pairs(df, ["a", "b", "c"], 400) and frozenset(("a", "c")) not in keys.tied_pairs(df, ["a", "b", "c"], 400)
    assert sorted(k.columns for k in keys.search(df, ["a", "b", "c"])) == [("a", "c"), ("b", "c")]


def test_hot_keys_are_numbered_in_ranges(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else "a" if i % 3 == 1 else f"k{i % 40}", (i * 37) % 211 if i % 7 else None, str(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, w string")
    monkeypatch.setattr(match, "STEP", 10)
    got = {(r["k"], r["v"], r["w"]): r["n"] for r in match.occurrences(df, ["k"], ["v", "w"], "n", hot=50).collect()}
    assert got == {(r["k"], r["v"], r["w"]): r["n"] for r in match.occurrences(df, ["k"], ["v", "w"], "n").collect()} and len(got) == 600
    same = spark.createDataFrame([("a", 1)] * 30, "k string, v int")
    assert sorted(r["n"] for r in match.occurrences(same, ["k"], ["v"], "n", hot=5).collect()) == list(range(1, 31))


def test_number_bands_split_ties(spark):
    values = [5.0] * 40 + [1.0] * 11 + [7.5, 9.0, 9.0, 11.0]
    df = spark.createDataFrame([(v, None if i % 9 == 0 else i % 2 == 0) for i, v in enumerate(values)] + [(None, True)], "x double, f boolean")
    got = [tuple(r) for r in profile.number_bands(df, F.col("x"), F.col("f")).orderBy("band").collect()]
    ranked = sorted(((v, -1 if i % 9 == 0 else int(i % 2 == 0)) for i, v in enumerate(values)))
    for b in range(5):
        part = ranked[b * 11 : b * 11 + 11]
        known = [f for _, f in part if f >= 0]
        assert got[b][:5] == (b + 1, part[0][0], part[-1][0], len(known), sum(known))
    assert profile.number_bands(df.limit(0), F.col("x"), F.col("f")).count() == 0


def test_possible_kinds_and_span(spark):
    df = spark.createDataFrame([("01/02/24", "A9"), ("05/06/24", "A10"), (None, None)], "d string, k string")
    assert {tuple(r) for r in sniff.possible_kinds(df, "d").collect()} == {("text", None), ("date", "%d/%m/%y")}
    assert tuple(keys.span(df, "k").first()) == (3, 2, "A9", "A10") and tuple(keys.span(df.limit(0), "k").first()) == (0, 0, None, None)


def test_whole_tables_are_read(spark):
    from plumbline.plans import derive, registry

    sf, run = "/root/testdata/sf0.001", registry.queries()
    assert run["key_span_whole"](spark, sf).first()["rows"] == derive.table(spark, sf, "customer").count()
    l, r = ([x["o_orderstatus"] for x in side(spark, sf).orderBy("o_orderkey").collect()] for side in (derive.left, derive.right))
    l, r = (x + [None] * (max(len(l), len(r)) - len(x)) for x in (l, r))
    got = {x["pos"]: (x["left_status"], x["right_status"]) for x in run["cmp_position_whole"](spark, sf).collect()}
    assert got == {i: (a, b) for i, (a, b) in enumerate(zip(l, r), 1) if a != b}
    assert 0 < run["key_overlap_whole"](spark, sf).first()["found"] < derive.table(spark, sf, "customer").count()


def test_quantiles_over_ranges(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=3000).round(2), "b": np.repeat([1.0, 5.0, 5.5], [7, 900, 93]), "c": np.array([4.0])}
    shares = [0.01, 0.05, 0.25, 0.5, 0.75, 0.99]
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    for ranges in (256, 4):
        monkeypatch.setattr(profile, "RANGES", ranges)
        got = {r["g"]: r["q"] for r in profile.quantiles(df, "g", shares).collect()}
        assert got == {g: pytest.approx(np.quantile(xs, shares).tolist()) for g, xs in values.items()}
    assert profile.quantiles(df.limit(0), "g", shares).count() == 0


def test_follow_ups_on_small_sides(spark):
    l, r = sides(spark)
    m = match.keyed(l, r, ["id"], ["v"])
    two = [(x["id"], x["side"], x["v"], x["w"], x["marks"]) for x in readback.above_below(m, ["id"], ["v", "w"]).orderBy("id", "side").collect()]
    assert two == [("1", "A", "a", "10", ["v", "w"]), ("1", "B", "A", "10.0", ["v", "w"]), ("2", "A", None, "20", ["w"]), ("2", "B", None, "21", ["w"])]
    assert [tuple(x) for x in readback.unmatched_samples(m, ["id"]).collect()] == [("left", "3"), ("right", "4")]  # 4 of 5 match
    assert readback.unmatched_samples(m, ["id"], least=0.8).count() == 0 and readback.unmatched_samples(match.keyed(l.limit(0), r, ["id"], ["v"]), ["id"]).count() == 0
    assert {x["side"]: x["n"] for x in readback.side_histogram(m, "w", 1).collect()} == {"l": 5, "r": 5}
    top = profile.column_summary(spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "v string"), ["v"]).first()
    assert tuple(top) == ("v", 5, 4, 80.0, 2, "a", 40.0)
    assert profile.column_summary(spark.createDataFrame([(None,)], "v string"), ["v"]).first()["top"] is None
    odd = spark.createDataFrame([(f"A{i % 10}",) for i in range(95)] + [("zz",), ("b-1",)], "v string")
    assert tuple(observe.odd_shapes(odd, ["v"]).first()) == ("v", "A9", 97.94, 2, ["b-1", "zz"], False) and observe.odd_shapes(odd, ["v"], least=99).count() == 0
    assert readback.case_probe(spark.createDataFrame([("a",)], "v string"), spark.createDataFrame([("A",)], "v string"), ["v"]).count() == 0
    early = spark.createDataFrame([("1899-12-31",), ("2030-01-01",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    x = observe.date_outliers(early, ["d"], "2026-01-01").first()
    assert (x["filled"], x["future"], x["before_1900"], x["first"]) == (2, 1, 1, "1899-12-31 00:00:00")


def test_multiset_mode_ledger_and_roll_up(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,v\n1,a\n1,a\n2,b\n")
    (tmp_path / "r.csv").write_text("id,v,w\n1,a,0\n2,b,0\n2,c,0\n")
    base = {"left": {"path": f"{tmp_path}/l.csv"}, "right": {"path": f"{tmp_path}/r.csv"}, "out": f"{tmp_path}/out"}
    pairs = [{"mode": "multiset", "out": f"{tmp_path}/out/m"}, {"keys": ["id"], "out": f"{tmp_path}/out/k"}]
    assert cli.run(spark, base | {"pairs": pairs}) == 1
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/m/row_count_diffs.csv").collect()
    assert {tuple(r) for r in rows} == {("1", "a", "2", "1"), ("2", "c", "0", "1")}
    both = spark.read.option("header", True).csv(f"{tmp_path}/out/summary.csv").collect()
    assert [(r["matched"], r["only_left"], r["only_right"]) for r in both] == [("2", "1", "1"), ("2", "1", "1")] and both[1]["columns_only_right"] == "w"
    ledger = {r["column_name"]: (r["role"], r["matched"], r["mismatched"]) for r in spark.read.parquet(f"{tmp_path}/out/k/columns.parquet").collect()}
    assert ledger == {"id": ("key", None, None), "v": ("compared", 2, 0), "w": ("only_right", None, None)}
    assert cli.run(spark, {"left": base["left"], "right": base["left"], "mode": "multiset"}) == 0


def test_whole_profile(spark, tmp_path):
    df = spark.createDataFrame([(f"K{i:03d}", f"{i * 1.5}", str(3 * i), f"2024-01-{1 + i % 28:02d}") for i in range(60)], "k string, x string, y string, d string")
    names = profile_run.write(df, str(tmp_path / "p"), today="2024-01-20")
    assert names == ["statistics", "most_frequent", "least_frequent", "shapes", "odd_shapes", "raw_checks", "outliers", "correlations", "date_outliers", "keys", "dependencies", "notes", "casts"]
    table = lambda n: spark.read.parquet(f"{tmp_path}/p/{n}.parquet")
    assert {r["column_name"]: r["distinct_values"] for r in table("statistics").collect()} == {"k": 60, "x": 60, "y": 60, "d": 28}
    assert table("outliers").filter("column_name = 'x'").first()["p50"] == 44.25 and table("correlations").first()["r"] == 1.0
    assert table("date_outliers").first()["future"] == 16
    assert "k" in {r["columns"] for r in table("keys").collect()} and "k is unique" in {r["note"] for r in table("notes").collect()} and table("dependencies").count() == 0
    assert set(profile_run.tables(df.select("k"))) == {"statistics", "most_frequent", "least_frequent", "shapes", "odd_shapes", "raw_checks"}


def workbook(path, sheets, styles=""):
    """A workbook with the standard library: sheet name to rows of (reference, type, style, text)."""
    import zipfile
    from xml.sax.saxutils import escape

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings = []
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}" state="{"hidden" if n == "Hidden" else "visible"}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            rows = []
            for r, cells in sheets[n]:
                out = []
                for ref, kind, style, text in cells:
                    if kind == "s":
                        strings.append(text)
                        text = len(strings) - 1
                    out.append(f'<c r="{ref}{r}" t="{kind}" s="{style}">' + (f"<is><t>{escape(str(text))}</t></is>" if kind == "inlineStr" else f"<v>{escape(str(text))}</v>") + "</c>")
                rows.append(f'<row r="{r}">' + "".join(out) + "</row>")
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(rows) + "</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in strings) + "</sst>")


def test_sheets(spark, tmp_path):
    from plumbline.sources import sheets

    head = (2, [("B", "s", 0, "id"), ("C", "s", 0, "when"), ("E", "s", 0, "id")])
    body = [(r, [("B", "n", 0, r * 10), ("C", "n", 1, 45000 + r), ("D", "b", 0, 1), ("E", "inlineStr", 0, "a & b"), ("F", "e", 0, "#N/A")]) for r in range(3, 23) if r != 20]
    path = str(tmp_path / "b.xlsx")
    workbook(path, {"Hidden": [(1, [("A", "n", 0, 1)])], "Data": [head, *body], "Time": [(1, [("A", "n", 2, 45000.5), ("B", "n", 0, 1.25), ("C", "n", 1, 59)])]})
    df = sheets.read_sheet(spark, path, range="B2:F", rows=4)
    assert df.columns == ["id", "when", "column3", "id_2", "column5"] and df.rdd.getNumPartitions() > 3
    rows = sorted(tuple(r) for r in df.collect())
    assert len(rows) == 19 and ("30", "2023-03-18", "true", "a & b", None) in rows
    assert sheets.read_sheet(spark, path, range="B2:C", stopatblank=True).count() == 17
    assert sheets.read_sheet(spark, path, sheet="time", header=False).first()[:] == ("2023-03-15 12:00:00", "1.25", "1900-02-28")
    assert load.Source(path, cells="B2:C5").load(spark, number=True).count() == 3 and load.kind_of("x.xlsx") == "sheet"
    for bad in ({"sheet": "no"}, {"range": "F2:B1"}, {"range": "?"}, {"range": "X90"}):
        with pytest.raises(Exception, match="sheet|range|before|no cells"):
            sheets.read_sheet(spark, path, **bad).collect()
    with pytest.raises(ValueError, match="xlsx"):
        sheets.read_sheet(spark, "old.xls")


def test_filter_rows(spark):
    from plumbline.functions import filter_rows as R

    reads = {"day": R.Read("date", "%d/%m/%Y", "%m/%d/%Y"), "n": R.Read("number"), "ok": R.Read("boolean"), "at": R.Read("timestamp")}
    row = lambda c, o, v="", to="both", kind="auto": {"column": c, "operator": o, "value": v, "apply to": to, "type": kind}
    make = lambda *rows: R.build(spark, rows, reads, ("old", "new"))
    for rows, said in (
        ([row("day", "=", "03/04/2024")], "spell it 2024-04-03 or 2024-03-04"), ([row("day", "=", "soon")], "not a date"), ([row("n", ">", "x")], "not a number"), ([row("n", ">", "inf")], "not a number"),
        ([row("n", "between", "1")], "two values"), ([row("n", ">", "1"), row("n", "<", "a", kind="text")], "same type"), ([row("n", "near", "1")], "no operator"),
    ):
        with pytest.raises(R.Refused, match=said):
            make(*rows)
    got = make(row("day", ">=", "03/04/2024", "old"), row("n", "in", "1, 2.50"), row("ok", "=", "Yes"), row("at", "<", "2024-01-02 10:00:00"), row("day", "!=", "25/12/2024", "old"), row("", "="))
    assert [(f.column, f.value, f.kind) for f in got.both] == [("n", ("1", "2.50"), "number"), ("ok", "true", "text"), ("at", "2024-01-02 10:00:00", "timestamp")]
    assert [f.value for f in got.left] == ["2024-04-03", "2024-12-25"] and not got.right
    assert make(row("day", "=", "25/12/2024")).both[0].value == "2024-12-25"  # one side alone can read it
    same = R.build(spark, [row("x", "=", "1", "B · t")], {}, ("t", "t"))
    assert same.right and not same.both
    left = spark.createDataFrame([("02/04/2024", "1"), ("03/04/2024", "1"), (None, "1"), ("25/12/2024", "1"), ("04/04/2024", "2.5"), ("05/04/2024", "9")], "day string, n string")
    some = make(row("day", ">=", "03/04/2024", "old"), row("n", "in", "1,2.50"))
    assert sorted(r[0] for r in left.filter(some.of_side("left", reads)).collect()) == ["03/04/2024", "04/04/2024", "25/12/2024"]
    m = match.keyed(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id int, v string"), ["id"], [], "unique")
    both, one = (R.build(spark, [row("v", "!=", "a", to)], {}, ("old", "new")) for to in ("both", "old"))
    assert sorted(r["id"] for r in m.filter(both.of_match()).collect()) == [2, 3, 4] and sorted(r["id"] for r in m.filter(one.of_match()).collect()) == [3, 4]


def test_databases(spark, tmp_path):
    from plumbline.sources import databases

    jdbc = {"url": f"jdbc:derby:{tmp_path}/db;create=true;user=app;password=hidden", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(i, f"n{i}") for i in range(20)], "ID int, NAME string").write.format("jdbc").options(**jdbc).option("dbtable", "things").save()
    got = databases.test_connection(spark, jdbc)
    assert got.ok and got.who.lower() == "app" and got.error is None
    assert [c.lower() for c, _ in databases.query_columns(spark, jdbc, "SELECT id, name FROM things")] == ["id", "name"]
    parts = jdbc | {"partitionColumn": "ID", "lowerBound": "0", "upperBound": "20", "numPartitions": "4"}
    df = load.Source(query="SELECT id, name FROM things WHERE id > 4", jdbc=parts).read(spark)
    assert df.count() == 15 and {t for _, t in df.dtypes} == {"string"} and df.rdd.getNumPartitions() == 4
    bad = databases.test_connection(spark, jdbc | {"url": "jdbc:derby:/nowhere/at/all;user=app;password=hidden"})
    assert not bad.ok and bad.error and "hidden" not in bad.error
    with pytest.raises(ValueError):
        databases.query_columns(spark, jdbc, "DROP TABLE things")


def test_set_aside_rows_go_beside_the_run(spark, tmp_path):
    for side, wide in (("a", ""), ("b", "3,4,5\n")):
        (tmp_path / f"{side}.csv").write_text("id,v\n1,x\n2,y\n" + wide)
    block = {"left": {"path": f"{tmp_path}/a.csv"}, "right": {"path": f"{tmp_path}/b.csv", "bad_rows": "set_aside"}, "keys": ["id"], "out": f"{tmp_path}/out"}
    assert cli.run(spark, block) == 0
    assert [r["raw"] for r in spark.read.parquet(f"{tmp_path}/out/set_aside_right.parquet").collect()] == ["3,4,5"] and not (tmp_path / "out" / "set_aside_left.parquet").exists()


def test_mapping_round_trip(spark):
    from plumbline.plans import mapping as M

    pairs = [M.Pair("Emp No", "id", "id", left_steps=(("strip_leading_zeros",),), key=True), M.Pair("pay", "Salary", "salary", diff.Rule("number", tolerance=0.5))]
    again, said = M.from_json(M.to_json(pairs), ["Emp No", "pay"], ["id", "Salary"])
    assert again == pairs and not said and "formats" not in M.to_json(pairs)
    some, said = M.from_json(M.to_json(pairs), ["Emp No"], ["id", "Salary"])
    assert some == pairs[:1] and said == ["salary was left out: 'pay' is not on the left side"]
    for old, new in (('"strip_leading_zeros"', '"burn"'), ('"tolerance"', '"slack"'), ('"version": 1', '"version": 2'), ('"name": "salary"', '"name": "ID"')):
        with pytest.raises(ValueError):
            M.from_json(M.to_json(pairs).replace(old, new), ["Emp No", "pay"], ["id", "Salary"])
    left = spark.createDataFrame([("007", "10.2"), ("8", "5")], "`Emp No` string, pay string")
    right = spark.createDataFrame([(7, 10.0), (8, 6.0)], "id int, Salary double")
    l, r = M.apply(left, right, pairs)
    m = match.keyed(l, r, ["id"], [], "unique")
    got = diff.cells(m, ["id"], ["salary"], diff.Options(rules={p.name: p.rule for p in pairs}))
    assert [(x["id"], x["left_value"]) for x in got.collect()] == [("8", "5")]
    fixed = M.with_fix(pairs[1], ((("trim",),), ()))
    assert fixed.left_steps == (("trim",),) and fixed.right_steps == ()


def test_notes_of_columns(spark):
    rows = [(f"{i}", "A" if i % 2 else "a", None, "x", "007" if i == 3 else str(i % 5), "nan" if i == 4 else str(10 + i % 3), "2031-01-01" if i == 5 else "2020-01-02") for i in range(100)]
    df = spark.createDataFrame(rows, "user_id string, letter string, gone string, same string, lot string, size string, day string")
    kinds = {"user_id": "text", "letter": "text", "gone": "text", "same": "text", "lot": "number", "size": "number", "day": "date"}
    found = {(r["column_name"], r["note"]): (r["n"], r["percent"], r["example"]) for r in notes.column_notes(df, kinds, "2025-01-01").collect()}
    assert found["user_id", "unique"] == (100, 100.0, None) and found["gone", "empty"] == (100, 100.0, None) and found["same", "constant"] == (100, 100.0, "x")
    assert found["letter", "category"] == (2, 2.0, "A, a") and found["letter", "case"] == (2, 2.0, "A / a") and found["lot", "leading_zeros"][0] == 1
    assert found["day", "future"] == (1, 1.0, None) and found["day", "dominant"] == (99, 99.0, "2020-01-02") and found["day", "outliers"][0] == 1
    assert ("letter", "dominant") not in found and ("gone", "nulls") not in found
    assert notes.column_notes(df.limit(0), kinds).count() == 0
    odd = spark.createDataFrame([("a", None), ("a", None)], "`a.b c` string, `values` string")
    assert {(r["column_name"], r["note"]) for r in notes.column_notes(odd.toDF("a_b c", "values"), {}).collect()} == {("a_b c", "constant"), ("values", "empty")}
    with pytest.raises(ValueError):
        notes.column_notes(df.select(), {})


def test_sentences_and_headline(spark, tmp_path):
    df = spark.createDataFrame([(f"K{i:02d}", "x", "pq"[i % 2], "QP"[i % 2]) for i in range(40)], "k string, one string, p string, q string")
    out = profile_run.findings(df, {c: "text" for c in df.columns})
    said = [r["note"] for r in out["notes"].collect()]
    assert said[0] == "40 rows x 4 columns · key: k · 0 repeated rows · 1 constant column"
    assert "one has one value: x" in said and "p is a category of 2 values: p, q" in said and said[-1] == "p and q are one-to-one"
    assert out["notes"].filter("finding = 'category' and column_name = 'q'").first()["n"] == 2


def test_key_combination_and_bucket_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (None, None)], "x int, y string")
    assert tuple(keys.combo(df, ["x", "y"]).first()) == (5, 4, 1, 3, False, {"x": 1, "y": 3})
    assert tuple(keys.combo(df, ["x", "y"], True).first()) == (5, 3, 2, 3, False, {"x": 1, "y": 3})
    assert tuple(keys.combo(df.limit(0), ["x"]).first()) == (0, 0, 0, 0, True, {})
    assert [tuple(r) for r in keys.repeated(df, ["x", "y"], nulls_same=False).collect()] == [(1, "a", 2)]
    left = spark.createDataFrame([("A9", 1, "l"), ("A10", 2, "l"), ("B", 3, "l")], "k string, v int, mine string")
    right = spark.createDataFrame([("B", 4, "r")], "k string, v int, yours string")
    m = match.keyed(left, right, ["k"], [], "unique")
    assert [r.asDict() for r in readback.bucket_rows(m, "differ", ["k"], ["v", "mine", "yours"]).collect()] == [{"k": "B", "a_v": 3, "b_v": 4, "a_mine": "l", "b_yours": "r"}]
    assert {tuple(r) for r in readback.bucket_rows(m, "left", ["k"], ["v", "yours"]).select("k", "v").collect()} == {("A9", 1), ("A10", 2)}
    assert [tuple(r) for r in readback.key_compare(m, "k").collect()] == [("A", 3, 1, 2, 2, "A9", "A10"), ("B", 1, 1, 0, 0, None, None)]


def test_ready_made_columns(spark):
    df = spark.createDataFrame([("2024-03-09 07:08:09", " ab ", "1.005"), ("no date", None, "x")], "t string, u string, n string")
    out = Source(derived={"m": ["minute", "t"], "y": ["year", "t"], "u2": ["upper", "u"], "r": ["round", "n"], "s": "concat(u, '!')"}).cut(df).collect()
    assert [tuple(r)[3:6] for r in out] == [("2024-03-09 07:08:00", "2024", "AB"), (None, None, None)] and out[0]["s"] == " ab !" and out[1]["r"] is None
    with pytest.raises(ValueError):
        Source(derived={"m": ["week", "t"]}).cut(df)


def test_readings_of_both_sides(spark):
    left = spark.createDataFrame([(f"k{i}", f"{i % 12 + 1:02d}/{i % 28 + 1:02d}/2024", f"{1000 + i:,}", "yn"[i % 2], f"{i % 12 + 1:02d}/{i % 11 + 1:02d}/2023", "1" if i else "x") for i in range(60)], "k string, sold string, price string, flag string, seen string, odd string")
    right = spark.createDataFrame([(f"k{i}", f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", f"{1000 + i}", "YN"[i % 2], f"2023-{i % 11 + 1:02d}-{i % 12 + 1:02d}", "abc"[i % 3]) for i in range(60)], "k string, sold string, price string, flag string, seen string, odd string")
    of = lambda df: {r["column_name"]: r for r in sniff.spellings(df, df.columns).collect()}
    a, b = of(left), of(right)
    got = {c: auto.decide(c, a[c], b[c]) for c in left.columns}
    assert (got["sold"].kind, got["sold"].formats) == ("date", (("%m/%d/%Y",), ())) and "day or month" not in got["sold"].note
    assert got["price"].kind == "number" and got["price"].steps == ((("remove_thousands",),), ()) and got["flag"].kind == "boolean"
    assert got["seen"].formats == (("%d/%m/%Y",), ()) and "left: day or month may come first" in got["seen"].note
    assert got["odd"].kind == "text" and got["odd"].note == "odd is text: only the left side converts" and got["k"] == auto.Reading()
    pairs = [(c, c, 1.0) for c in left.columns]
    l, r = auto.sides(left, right, pairs, {c: x.kind for c, x in got.items()}, got)
    same = match.keyed(l, r, ["k"], [], "unique")
    assert diff.cells(same, ["k"], ["sold", "price", "flag", "seen"]).count() == 0
    empty = left.limit(0)
    assert auto.decide("sold", of(empty).get("sold"), b["sold"]).kind == "text"


def test_stages_of_a_value(spark):
    df = spark.createDataFrame([(" 1,5 ",), ("n/a",), (None,), ("x",)], "v string")
    spec = V.ColSpec("w", "v", "number", (("remove_thousands",), ("trim",)))
    assert [tuple(r) for r in V.stages(df, spec).collect()] == [(" 1,5 ", "15", "15", True), ("n/a", "n/a", None, None), (None, None, None, None), ("x", "x", "x", False)]
    assert {r["converts"] for r in V.stages(df, V.ColSpec("v")).collect()} == {None}


def test_profile_of_a_run(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,v\n1,a\n2,b\n3,\n")
    (tmp_path / "r.csv").write_text("id,v\n1,a\n2,c\n9,c\n")
    cli.run(spark, {"left": {"path": f"{tmp_path}/l.csv"}, "right": {"path": f"{tmp_path}/r.csv"}, "out": f"{tmp_path}/o", "keys": ["id"], "profile": True})
    rows = {r["side"]: (r["column_name"], r["rows"], r["nulls"], r["distinct_values"]) for r in spark.read.parquet(f"{tmp_path}/o/profile.parquet").collect()}
    assert rows == {"l": ("v", 3, 1, 2), "r": ("v", 3, 0, 2)}


def test_filter_formats_and_refusals(spark):
    df = spark.createDataFrame([("03/04/2024",), ("04/03/2024",), (None,)], "d string")
    asked = P.parse("d:date > 2024-03-10")
    assert [r["d"] for r in df.filter(P.compile(asked, formats={"d": ["%m/%d/%Y"]})).collect()] == ["04/03/2024"]
    assert [r["d"] for r in df.filter(P.compile(asked)).collect()] == ["03/04/2024"]
    for bad in ("n:number > abc", "n:number in (1, 2, x)", "n:number between 1..1_0"):
        with pytest.raises(ValueError):
            P.compile(P.parse(bad))


def test_reasons_of_keys():
    assert keys.Candidate(("order_id",), 5, 5, 0.0).reasons() == ["unique on every row", "the name order_id says identifier", "none of its values is on the other side"]
    assert keys.Candidate(("amount", "row_hash"), 4, 5, 50.0, minimal=False).reasons() == ["1 rows share a key with another", "row_hash: a checksum, unique by construction", "amount: a measure", "the name row_hash says identifier", "50 % of its values are on the other side", "holds a smaller key"]
