"""Operators 1 to 10 on the small tables, held against brute force."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import graph, langid, licenses, linededup, mixing, mtree, packing, queries, simhash, sstable, tokens, vectors, warc
from plumbline.llm.common import open_store, scratch

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    if name not in ids_of.__dict__:
        ids_of.__dict__[name] = Tokenizer.from_file(tokens.vocabulary(name))
    tok = ids_of.__dict__[name]
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.mark.parametrize("name", [tokens.WORD_BPE, tokens.BYTE_BPE])
def test_encoder_equals_the_library(name, docs):
    enc = tokens.encoder(tokens.vocabulary(name))
    odd = ["", " ", "a", "  a  b ", "a\n b", "x\t\ty", "It's we'll'd", "naïve ÇA ŒUVRE İstanbul ß", "é ́a", "日本語 のテキスト", "1,234.50 % $$$", "<|endoftext|> x <|startoftext|>", "a b  c", "end. ", "\x1c a\x85b", "word" * 50, "A.B.C, d", "👍🏽 ok", "tab\x0bvt \x0cff", "don't CAN'T"]
    rng = random.Random(5)
    parts = ["a", "Word", "é", "´", "\u0301", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\0", "\x85", "\u3000", ".", ",", "'s", "'", "$$", "12", "²", "日本", "👍🏽", "<|endoftext|>", "<|startoftext|>", "<|", "×", "ÿ"]
    odd += ["a <|endoftext|> b", "<|", *["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(3000)]]
    texts = [*odd, None, *[r[1] for r in docs]]
    for text, ids in zip(texts, enc.encode_all(pa.array(texts)), strict=True):
        assert ids + np.array([7], "<u4").tobytes() == ids_of(name, text, 7), text[:80]
        assert enc.encode(text) == ids


def test_op1_round_trip(spark, docs):
    out = sorted(queries.op1_token_tables(spark, SF).collect(), key=lambda r: r["doc_id"])
    at = 0
    for row, (doc_id, text, *_) in zip(out, sorted(docs), strict=True):
        want = ids_of(tokens.WORD_BPE, text, queries.WORD_END)
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, at, len(want) // 4, zlib.crc32(want))
        at += len(want) // 4


def test_op1_edges_and_lookup(spark):
    rows = [(5, "a b"), (None, "c"), (-3, None), (5, "a b"), (5, ""), (2**62, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, k int, t string")
    folder = scratch(spark, "sst-test")
    manifest = sstable.write_tables(df, folder, tokens.vocabulary(tokens.WORD_BPE), 2)
    out = sstable.read_tables(manifest, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, -3, 5, 5, 5, 2**62]
    store, base = open_store(folder)
    found = []
    for r in manifest.collect():
        with store.open_input_file(f"{base}/{r['path']}") as f:
            t = sstable.Table(f)
            found += t.get(sstable.key_of(5))
            assert t.get(sstable.key_of(6)) == []
    assert len(found) == 3
    with pytest.raises(ValueError):
        sstable._pack(np.array([70_000], "<u4").tobytes(), wide=False)
    empty = sstable.tokenised_tables(df.limit(0), tokens.vocabulary(tokens.WORD_BPE), 2)
    assert empty.count() == 0


def test_op1_many_blocks():
    import io

    import pyarrow as pa

    out = io.BytesIO()
    w = sstable.Writer(out)
    keys = [sstable.key_of(i * 3) for i in range(20_000)]
    for k in keys:
        w.add(k, k * 3, 1)
    w.close()
    t = sstable.Table(pa.BufferReader(out.getvalue()))
    assert len(t.blocks) > 5 and [k for k, _ in t] == keys
    for i in (0, 1, 2, 29_997, 3 * 777, 59_997, 60_000):
        assert t.get(sstable.key_of(i)) == ([sstable.key_of(i) * 3] if i % 3 == 0 and i < 60_000 else [])


def test_op2_follows_targets(spark):
    out = queries.op2_source_mix(spark, SF2).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF2}/documents.parquet'")
    want = con.sql(mixing.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    got = out[want.columns].sort_values("doc_id").reset_index(drop=True)
    assert (got == want).all().all()
    assert (out["taken"] <= 3 * out["size"]).all()
    per = out.merge(con.sql("select doc_id, source from documents").df(), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), big=("size", "max"))
    assert ((per["taken"] - per["target"]).abs() <= 2 * per["big"]).all()
    assert math.isclose(per["target"].sum(), out["size"].sum(), rel_tol=1e-9)


def test_op2_edges(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "d e", "y"), (None, "d e", "y"), (4, "f " * 50_000, "z")]
    df = spark.createDataFrame([(*r, 9, "q") for r in rows], "doc_id long, text string, source string, size int, key string")
    out = mixing.mix(df).collect()
    assert len(out) == 6 and {r["size"] for r in out} == {3, 0, 2, 50_000}
    assert mixing.mix(df.limit(0)).count() == 0
    one = spark.createDataFrame([(7, f"w {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    assert mixing.mix(one, keep=("text",)).selectExpr("count(distinct text)", "sum(taken)").first()[:] == (3000, 6000)
    assert mixing.mix(df.filter("size is null or doc_id in (2, 3)")).agg({"taken": "sum"}).first()[0] == 0


def test_op2_equal_rows_are_summed_in_lots(spark, monkeypatch):
    rows = [(1, "a b", "x")] * 900 + [(None, None, None)] * 700 + [(1, "a b", "y")] * 50 + [(i, f"w {i} " * (1 + i % 9), "xyz"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(con.sql(mixing.oracle()).fetchall(), key=str)
    for lot in (65_536, 40):
        monkeypatch.setattr(mixing, "LOT", lot)
        got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert sorted([tuple(r) for r in got], key=str) == want


def brute_vectors(rows, score, k, every):
    out = []
    for i, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            best = sorted((score(v, w), 2**63 if o is None else o) for j, (o, w) in enumerate(rows) if j != i)[:k]
            out += [(q, n + 1, None if o == 2**63 else o, s) for n, (s, o) in enumerate(best)]
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


@pytest.mark.parametrize("seed", [1, 2])
def test_op3_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 300)
    rng = np.random.default_rng(seed)
    base = np.round(rng.normal(0, 0.4, (700, 6)), 2)
    base[100:200] = base[5]
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)] + [(None, [0.5] * 6), (40, [0.1] * 6), (40, [0.1] * 6)]
    odd = [(60, None), (80, [None] * 6), (100, [float("nan")] * 6), (120, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, v int")
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], -r["score"]) for r in mtree.top_inner(df).collect()), key=lambda r: (r[0], r[1], r[3]))
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    assert got == brute_vectors(ints, lambda a, b: -sum(x * y for x, y in zip(a, b)), 20, 20)
    assert mtree.top_inner(df.limit(0)).count() == 0


def test_op3_prunes(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(mtree, "PAGE", 64)
    rng = np.random.default_rng(0)
    x = np.floor(64 * np.concatenate([rng.normal(c, 0.05, (1500, 8)) for c in rng.normal(0, 1, (4, 8))])).astype(np.int64)
    pages, top = mtree.build(x)
    assert sum(len(p["rows"]) for p in pages if p["leaf"]) == len(x) and len(pages) > 10
    frame = pd.DataFrame({"v": x.tolist(), "dim": 8, "shard": 0, "members": [[{"vec_id": i, "rid": i}] for i in range(len(x))]})
    tree = mtree.Tree(mtree._pages(frame))
    for i in range(0, len(x), 500):
        got = sorted(tree.query(x[i], 20, i), key=lambda r: (-r[2], r[0]))[:20]
        s = x @ x[i]
        want = sorted((-int(s[j]), j) for j in range(len(x)) if j != i)[:20]
        assert [(-int(v), int(j)) for j, _, v in got] == want
    assert tree.computed < 12 * len(x) / 2


def test_op4_held_out_accuracy(spark, docs):
    out = queries.op4_language(spark, SF2).toPandas().set_index("doc_id")
    truth = duckdb.connect().sql(f"select doc_id, lang from '{SF2}/documents.parquet'").df().set_index("doc_id")["lang"]
    held = out[out["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in out["held_out"].items())
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_op4_edges(spark):
    rows = [(i, "the cat sat on the mat and that was that " * 20, "en") for i in range(40)] + [(100 + i, "le chat est dans la maison avec les autres " * 20, "fr") for i in range(40)]
    rows += [(None, "the cat", "en"), (201, None, "en"), (202, "", "en"), (203, "123 $$$", "fr"), (204, "the mat " * 30_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    net = langid.train(df)
    got = {r["doc_id"]: r["guess"] for r in langid.identify(df, net).collect()}
    assert got[201]["lang"] == got[202]["lang"] == got[203]["lang"] == "und" and got[204]["lang"] == "en"
    assert all(got[i]["lang"] == "en" and got[100 + i]["lang"] == "fr" for i in range(40))
    assert langid.train(df, per_lang=2).langs == ["en", "fr"]  # a share of the hashes, as on large tables
    signs = spark.createDataFrame([(1, "½ ②"), (2, "_ 12"), (3, "ʰ")], "doc_id long, text string")  # a modifier letter is a letter
    assert [r["guess"]["lang"] == "und" for r in langid.identify(signs, net).orderBy("doc_id").collect()] == [True, True, False]
    assert langid.train(df.limit(0)) is None and langid.identify(df.limit(0), None).count() == 0


def test_op4_network_equals_plain_loops():
    rng = np.random.default_rng(8)
    net = langid.Net(["a", "b", "c"]).ready()
    texts = ["The cat", "é" * 300, "x" * 1300 + "yz"]
    x, owner, sizes = langid.windows_of(texts)
    assert owner.tolist() == [0, 1, 1, 2, 2, 2] and sizes.tolist() == [7, 512, 88, 512, 512, 278]
    for row, got in zip(x, net.predict(x)):
        features = []
        for width, table in zip(langid.WIDTHS, net.tables):
            for f in range(langid.FILTERS):
                best = max(sum(float(table[j, row[at + j], f]) for j in range(width)) for at in range(len(row) - width + 1))
                features.append(max(best, 0))
        z = [sum(v * float(w) for v, w in zip(features, net.dense[:, k])) + float(net.bias[k]) for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert np.allclose(got, [v / sum(e) for v in e], atol=1e-4)


def test_op5_equals_sql_and_edges(spark):
    con = duckdb.connect()
    con.execute(f"create table documents as select doc_id, text from '{SF2}/documents.parquet'")
    long = " ".join(licenses.TEMPLATES["MIT"][2:])
    half = licenses.TEMPLATES["ISC"][0].split()
    rows = [(9001, "w " * 777 + long + " w" * 300), (9002, long.replace("charge", "cost")), (9003, None), (9004, ""), (9005, "Released under the MIT"), (9006, "x\nReleased under the MIT License. " + licenses.TEMPLATES["Apache-2.0"][2])]
    # halves of a passage in rows of one or no identifier are no match
    rows += [(k, " ".join(part)) for k in (None, 9007) for part in (half[:11], half[7:])] + [(None, "Released under the MIT License."), (None, "Released under the MIT License.")]
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.sql(licenses.oracle()).fetchall(), key=str)
    pdf = [(*r, 1, "h") for r in con.sql("select * from documents").fetchall()]
    df = spark.createDataFrame(pdf, "doc_id long, text string, at int, h string")
    got = sorted((tuple(r) for r in licenses.scan(df).select("doc_id", "license", "containment", "first_word").collect()), key=str)
    assert got == want
    names = collections.Counter((r[0], r[1]) for r in got)
    assert {(9001, "MIT"), (9002, "MIT"), (9006, "MIT"), (9006, "Apache-2.0")} <= names.keys() and not any(r[0] in (9003, 9004, 9005, 9007) for r in got)
    assert names[None, "MIT"] == 2 and sum(n for (i, _), n in names.items() if i is None) == 2
    assert licenses.scan(df.limit(0)).count() == 0


def test_op5_bands_miss_as_seldom_as_stated():
    rng = np.random.default_rng(1)
    for shared, stride in ((7, 4), (12, 8), (21, 16)):
        w, k = 4 * stride, licenses.BANDS[stride]
        stated = math.comb(w - shared, k) / math.comb(w, k)
        h = rng.random((20_000, w))
        missed = (np.argsort(h, axis=1)[:, :k] >= shared).all(axis=1).sum()
        assert stated < 0.0007 and missed <= 20_000 * stated * 2 + 5


def independent_text(page):
    """Plain text by the standard library's parser."""
    import html.parser

    class Text(html.parser.HTMLParser):
        out, off = "", 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "noscript", "template"):
                self.off += 1
                self.out += " "
            elif not self.off:
                self.out += "\n" if tag in warc._BLOCKS else ""

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript", "template"):
                self.off -= 1
            elif not self.off:
                self.out += "\n" if tag in warc._BLOCKS else ""

        def handle_data(self, data):
            self.out += "" if self.off else data

        def handle_comment(self, data):
            self.out += " "

        handle_decl = handle_comment

    t = Text(convert_charrefs=True)
    t.feed(page)
    t.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in t.out.split("\n")) if x)


def test_op6_round_trip(spark):
    import base64
    import hashlib

    pages = duckdb.connect().sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    odd = "<p>a&amp;b<br>c<script>x</script><a href='q?a=1&amp;b=2'>d</a>"
    rows = [*pages, (None, None, None), (7000, "u", ""), (7001, "http://x/\r\na", odd), (7001, "http://x/\r\na", "plain")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    out = warc.derivatives(df).collect()
    assert len(out) == len(rows) == len({r["response_id"] for r in out}) == len({r["conversion_id"] for r in out} | {r["metadata_id"] for r in out}) / 2
    by = {(r["page_id"], r["payload_digest"]): r for r in out}
    for page_id, url, page in rows:
        body = (page or "").encode()
        r = by[page_id, "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()]
        text = independent_text(page or "").encode()
        assert (r["text_bytes"], r["text_crc32"]) == (len(text), zlib.crc32(text))
        assert r["links"] == (page or "").lower().count("<a href=") and r["url"] == (url and url.replace("\r\n", " "))
    assert warc.plain_text(odd) == "a&b\nc d"
    assert warc.derivatives(df.limit(0)).count() == 0


def test_op6_records_read_by_an_independent_parser(spark):
    import gzip

    folder = scratch(spark, "warc-test")
    df = spark.createDataFrame([(1, "http://a/", "<title>T &amp; t</title><p>one <b>two</b>")], "page_id long, url string, html string")
    warc.write_derivatives(warc.write_responses(df, folder), folder).collect()
    store, base = open_store(folder)
    from pyarrow import fs

    found = {}
    for f in store.get_file_info(fs.FileSelector(base)):
        head, block = gzip.decompress(store.open_input_file(f.path).read()).split(b"\r\n\r\n", 1)  # one record a file
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        found[fields["WARC-Type"]] = fields, block[:-4]
    assert found["conversion"][1] == b"T & t\none two"
    assert b'"title": "T & t"' in found["metadata"][1] and b"HTTP/1.1 200 OK" in found["metadata"][1]
    for kind in ("metadata", "conversion"):
        assert found[kind][0]["WARC-Refers-To"] == found["response"][0]["WARC-Record-ID"]
        assert found[kind][0]["WARC-Source-Payload-Digest"] == found["response"][0]["WARC-Payload-Digest"]


@pytest.mark.parametrize("page", ["<!--" * 50_000, "<script>" * 50_000, "<title>" * 50_000, "<a " * 50_000, "<a href=" * 50_000])
def test_op6_hostile_pages_take_no_square_time(page):
    import time

    began = time.time()
    warc.plain_text(page)
    warc._TITLE.search(page)
    warc._LINK.findall(page)
    assert time.time() - began < 2


def test_op7_recall_and_edges(spark):
    rows = duckdb.connect().sql(f"select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    got = collections.defaultdict(list)
    for r in queries.op7_graph_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x, ids = np.array([v for _, v in rows], np.float32).astype(np.float64), np.array([i for i, _ in rows])
    hit = n = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]])
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(math.isclose(s, d[ids == v][0], rel_tol=1e-12) for _, v, s in mine)
        hit, n = hit + len(best & {m[1] for m in mine}), n + 10
    assert hit / n >= 0.95
    odd = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (100, [5.0, 5.0])] + [(i, [2.0, 2.0]) for i in range(4, 60)]
    df = spark.createDataFrame([(*r, 1) for r in odd], "vec_id long, embedding array<double>, dim int")
    keep = [(i, v) for i, v in odd if v and not any(math.isnan(a) for a in v) and any(v)]
    out = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in graph.nearest_neighbours(df).collect()), key=lambda r: (r[0], r[1], r[3]))
    assert out == brute_vectors(keep, lambda a, b: math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b))), 10, 100)
    assert graph.nearest_neighbours(df.limit(0)).count() == 0
    for scale in (1e25, 1e-25):  # beyond what single precision could square
        small = [(i, [scale * (i % 13), scale * (i % 7), scale]) for i in range(90)]
        got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in graph.nearest_neighbours(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()))
        want = brute_vectors(small, lambda a, b: math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b))), 10, 100)
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


def brute_simhash(rows):
    import re

    import xxhash

    prints = {}
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc_id] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    group = {d: d for d in prints}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                lo, hi = sorted((find(a), find(b)))
                group[hi] = lo
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


def test_op8_equals_brute_force(spark):
    rows = duckdb.connect().sql(f"select doc_id, text from '{SF2}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash_groups(spark, SF2).collect()}
    assert got == brute_simhash(rows)


def test_op8_edges_and_large_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = " ".join(f"w{i}" for i in rng.integers(0, 500, 400))
    near = [(i, base.replace(f"w{i}", "zz", 1) + f" t{i % 7}") for i in range(300)]
    rows = [*near, (1000, None), (1001, ""), (1002, " \t"), (1003, "ONE two"), (1004, "one TWO"), (1005, "É é x " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    want = brute_simhash(rows)
    for block in (4096, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash.similar_links, "__defaults__", (block,))
        got = {r["doc_id"]: (r["f"], r["component_id"]) for r in simhash.near_duplicates(df).select("doc_id", simhash.hexed(__import__("pyspark").sql.functions.col("fp")).alias("f"), "component_id").collect()}
        assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(twice).collect()] == [5] * 4


def check_packing(out, rows, capacity=2048, whole=True):
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for doc_id, text in rows:
        want, at = ids_of(tokens.BYTE_BPE, text, 1), 0
        for r in sorted(pieces.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) // 4 and r["ids_crc32"] == zlib.crc32(want[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(want) // 4
    assert not pieces
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at or not whole
            at += r["length"]
        assert at <= capacity
    return [sum(r["length"] for r in s) for s in seqs.values()]


def test_op9_covers_every_id(spark, docs):
    sizes = check_packing(queries.op9_pack_sequences(spark, SF).collect(), [r[:2] for r in docs])
    assert all(s == 2048 or s.bit_count() == 1 for s in sizes)  # no padding
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (-9, "x"), (4, "a <|endoftext|> b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    check_packing(packing.pack(df, tokens.vocabulary(tokens.BYTE_BPE), 1).collect(), rows)
    assert packing.pack(df.limit(0), tokens.vocabulary(tokens.BYTE_BPE), 1).count() == 0
    # null and repeated identifiers, and a pool that must be emptied on the way
    rows = [(None, "a b"), (None, "a b"), (7, "c " * 3000), (7, "c " * 3000)] + [(100 + i, "d e " * (i % 90)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = packing.pack(df, tokens.vocabulary(tokens.BYTE_BPE), 1, hold=90_000).collect()
    check_packing([r for r in out if r["doc_id"] and r["doc_id"] >= 100], rows[4:], whole=False)
    got = collections.Counter((r["doc_id"], r["start"]) for r in out if r["doc_id"] in (None, 7))
    assert got[None, 0] == got[7, 0] == 2 and sum(r["length"] for r in out if r["doc_id"] is None) == 2 * 3
    assert sum(r["length"] for r in out) == sum(len(ids_of(tokens.BYTE_BPE, t, 1)) // 4 for _, t in rows)


def test_op9_best_fill_is_best():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 60, rng.integers(1, 8)).tolist()
        count, room = collections.Counter(lengths), int(rng.integers(1, 120))
        used = packing.best_fill(sorted(count), count, room)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        assert all(0 < used[k] <= count[k] for k in used)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def brute_lines(rows, least):
    """The same tree, one leaf at a time."""
    import re

    def mask(line):
        return " ".join("<*>" if re.search("[0-9]", t) else t for t in re.sub("[ \\t\\r\x0b\f]+", " ", line).strip(" ").split(" "))

    lines = [(d, i, mask(raw)) for d, text in rows if text is not None for i, raw in enumerate(text.split("\n"))]
    lines = [x for x in lines if set(x[2].split(" ")) - {"<*>", ""}]
    count, leaves, tries = collections.Counter(x[2] for x in lines), collections.defaultdict(list), {}
    for line in count:
        leaves[line.count(" ") + 1, *line.split(" ")[:3]].append(line)
    for (width, *_), own in leaves.items():
        total = sum(count[x] for x in own)
        held = collections.Counter()
        for x in own:
            for at in enumerate(x.split(" ")):
                held[at] += count[x]
        for x in own:
            tries[x] = []
            for share in (4, 16, 64) if len(own) > 1 else ():
                t = [w if i < 3 or held[i, w] >= least and held[i, w] * share >= total else None for i, w in enumerate(x.split(" "))]
                if sum(w is not None for w in t) >= max(math.ceil(width * 0.7), 3 + math.ceil((width - 3) / 2)) and width > 3:
                    tries[x].append((share, " ".join(w or "<*>" for w in t)))
            tries[x].append((1000, x))
    docs = collections.defaultdict(set)
    for d, i, line in lines:
        for t in tries[line]:
            docs[t].add(d)
    where = collections.defaultdict(list)
    for d, i, line in lines:
        often = [t for t in tries[line] if len(docs[t]) >= least]
        if often:
            where[often[0]].append((d, i))
    lost = {x for v in where.values() for x in v if x != min(v)}
    return {d: text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in lost) for d, text in rows}


def test_op10_equals_brute_force(spark):
    rows = duckdb.connect().sql(f"select doc_id, text from '{SF2}/documents.parquet'").fetchall()
    rows += [(5000 + i, f"own{i} words here\nUser {i} logged in from host{i} at noon today\nshort\n\n  spaced   out line number{i}") for i in range(9)]
    rows += [(6000, None), (6001, ""), (6002, "User 77 logged in from elsewhere at noon today"), (6003, "long " * 30_000)]
    df = spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, line int")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring(df).collect()}
    want = brute_lines(rows, linededup.MIN_DOCS)
    assert got == want
    assert "logged" in got[5000] and "logged" not in got[5003] and "logged" not in got[6002]
    assert linededup.drop_recurring(df.limit(0)).count() == 0


def test_op10_large_leaf_keeps_its_rule(spark):
    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    # over 20,000 different lines of one lead and width, each in one document
    rows = [(d, f"own{word(d)}\n" + "\n".join(f"User logged in as {word(i)} from {word(3 * i + 1)}" for i in range(21 * d, 21 * d + 21))) for d in range(1000)]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: "\n".join(text.split("\n")[: 1 if d else 2]) for d, text in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_op10_mixed_leaves_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: f"t{chr(97 + int(n * rng.random() ** 3) % 26)}{chr(97 + int(n * rng.random() ** 3) // 26)}"
    rows = []
    for d in range(120):
        own = [" ".join(["in", "the", "end", *(word(60) if k % 3 else word(4) for k in range(rng.choice([1, 4, 7])))]) for _ in range(12)]
        own += [f"job {word(90)} started by {word(300)} on host{d}", rng.choice(["thanks", "bye", "read more"]), "12", ""]
        rows.append((d, "\n".join(own)))
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows, linededup.MIN_DOCS)
    assert sum("thanks" in t for t in got.values()) == 1 and all("12" in t.split("\n") for t in got.values())


def test_op10_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "same old line again", "keep", 7, "x", 4) for i in range(6)], "doc_id long, text string, h string, k int, drop string, __lost int")
    out = linededup.drop_recurring(df).collect()
    assert {(r["h"], r["k"], r["drop"]) for r in out} == {("keep", 7, "x")} and sorted(r["__lost"] for r in out) == [0, 1, 1, 1, 1, 1]


def test_op10_null_and_repeated_ids(spark):
    rows = [(None, "same old line again\nmine"), (None, "same old line again\nyours"), (1, "same old line again\na"), (1, "same old line again\na"), (2, "same old line again"), (3, "same old line again\nz")]
    out = linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6 and sum("same" in (r["text"] or "") for r in out) == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = duckdb.connect().sql(f"select doc_id, text from '{SF2}/documents.parquet'").fetchall()
    kept = cp.near_copies(spark, docs, SF2).collect()
    want = {c for _, c in brute_simhash(rows).values()}
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    stays = cp.language(spark, docs, SF2)
    assert stays.columns == docs.columns and stays.count() >= 0.995 * docs.count()
    mixed = cp.mixture(spark, docs, SF2).groupBy("doc_id").count().collect()
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed} == {d: n for d, n in taken.items() if n}
    assert cp.lines(spark, docs, SF2).columns == docs.columns
    out = cp.run(spark, SF).collect()
    assert out and max(r["offset"] + r["length"] for r in out) <= 2048


def test_pipeline_edges(spark):
    import corpus_pipeline as cp

    text = "one two three four five six seven"
    rows = [(None, text, None, "a", 1, "p"), (None, text, None, "a", 1, "q"), (3, "other words are here for once in a while", None, "a", 1, "r"), (4, None, None, None, None, "s"), (5, "", None, "b", 0, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    assert sorted(r["key"] for r in cp.language(spark, df, SF).collect()) == ["p", "q", "r"]  # nothing is labelled
    kept = cp.near_copies(spark, df, SF).collect()
    assert len([r for r in kept if r["text"] == text]) == 1 and len(kept) == 3
    mixed = cp.mixture(spark, df, SF).collect()
    assert {r["key"] for r in mixed} == {"p", "q", "r"} and set(mixed[0].asDict()) == set(df.columns)
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
        assert stage(spark, df, SF).count() >= 0
