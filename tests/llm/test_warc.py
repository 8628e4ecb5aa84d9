import hashlib

import duckdb

from pyspark.sql import functions as F

from occuflow.llm import warc


def expected(pages):
    first = {}
    for i, h in sorted(pages):
        b = (h or "").encode()
        if len(b) >= warc.MIN_REVISIT:
            first.setdefault(b, i)
    out = {}
    for i, h in pages:
        b = (h or "").encode()
        to = first.get(b, i)
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if to != i else "response", to if to != i else None)
    return out


def test_round_trip(spark, folder):
    htmls = [None, "", "x" * 99, "x" * 99, "x" * 100, "x" * 100, "é" * 50, "é" * 50, "<a>\r\n\r\nWARC/1.1" * 90, "big" * 400_000, "x" * 100]
    pages = list(enumerate(htmls))
    df = spark.createDataFrame([(i, "http://a/\r\nb" if i % 2 else None, h) for i, h in pages], "page_id long, url string, html string").repartition(4).withColumn("refers", F.lit(1))
    index = warc.archive(df, folder)
    rows = warc.read(index, f"{folder}/warc", payload=True).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows} == expected(pages)
    assert all(bytes(r["payload"]) == (htmls[r["page_id"]] or "").encode() for r in rows if r["record_type"] == "response")
    some = warc.read(index.where("page_id = 9"), f"{folder}/warc").collect()
    assert [r["page_id"] for r in some] == [9]


def test_one_id_with_different_payloads(spark, folder):
    a, b, c = "a" * 200, "b" * 200, "c" * 200
    pages = [(1, a), (2, b), (3, a), (3, b), (3, c), (None, a)]
    df = spark.createDataFrame([(i, "http://a/", h) for i, h in pages], "page_id long, url string, html string")
    rows = warc.read(warc.archive(df, folder), f"{folder}/warc", payload=True).collect()
    got = sorted(((r["page_id"] or 0, r["payload_digest"], r["refers_to"], bytes(r["payload"]).decode()) for r in rows), key=repr)
    of = lambda h: hashlib.sha256(h.encode()).hexdigest()
    want = [(1, of(a), None, a), (2, of(b), None, b), (3, of(a), 1, ""), (3, of(b), 2, ""), (3, of(c), None, c), (0, of(a), 1, "")]
    assert got == sorted(want, key=repr)


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 10 + warc.HOLE + 11, 5), ("b", 0, 3)]
    got = [(f, s, e, len(h)) for f, s, e, h in warc.ranges(rows)]
    assert got == [("a", 0, 20, 2), ("a", 10 + warc.HOLE + 11, 10 + warc.HOLE + 16, 1), ("b", 0, 3, 1)]


def test_empty(spark, folder):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.archive(df, folder), f"{folder}/warc").count() == 0


def test_clashing_columns_and_a_hot_payload(spark, folder):
    pages = [(i, "same payload " * 20) for i in range(300)] + [(7, "same payload " * 20)]
    df = spark.createDataFrame([(i, "http://a/", h) for i, h in pages], "page_id long, url string, html string")
    for c in ("refers_to", "d", "salt", "c", "n", "digest", "file", "offset"):
        df = df.withColumn(c, F.lit("mine"))
    rows = warc.read(warc.archive(df, folder), f"{folder}/warc").collect()
    assert len(rows) == len(pages) and sorted(r["page_id"] for r in rows) == sorted(i for i, _ in pages)
    assert all((r["refers_to"], r["record_type"]) == ((None, "response") if r["page_id"] == 0 else (0, "revisit")) for r in rows)


def test_pages_without_an_id(spark, folder):
    """They revisit the page of the least id; where no page of their payload has an id, or it is short, they are responses."""
    a, b, short = "a" * 200, "b" * 200, "c" * 50
    pages = [(None, a), (None, a), (4, a), (2, a), (None, b), (None, b), (None, short), (3, short), (None, None)]
    df = spark.createDataFrame([(i, None, h) for i, h in pages], "page_id long, url string, html string")
    rows = warc.read(warc.archive(df, folder), f"{folder}/warc").collect()
    of = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = [(i, of(h), 2 if h == a and i != 2 else None) for i, h in pages]
    assert sorted(((r["page_id"], r["payload_digest"], r["refers_to"]) for r in rows), key=repr) == sorted(want, key=repr)


def test_a_very_long_page(spark, folder):
    html = "<p>é</p>" * 500_000
    df = spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", html)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.read(warc.archive(df, folder), f"{folder}/warc", payload=True).collect()}
    assert bytes(rows[1]["payload"]).decode() == html and (rows[2]["refers_to"], rows[2]["payload_bytes"]) == (1, len(html.encode()))


def test_sql_twin_agrees_with_null_ids(spark, tmp_path):
    a = "a" * 200
    rows = [(None, "u", a), (1, "u", a), (5, "u", a), (None, "u", "b" * 150), (7, "u", None), (None, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(warc.SQL["op9_warc"]).fetchall()
    got = warc.op9_warc(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
