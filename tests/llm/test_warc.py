from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import functions as F

from rangeweave.llm import warc

from .helpers import by_id, saved

PAGES = "page_id long, url string, html string"


def rows():
    big, other = "<p>" + "é" * 600, "<b>" + "x" * 2000
    out = [(i, f"https://Host{i % 5}.example.com:80/p/{i % 40}?q={i}#f", f"page {i} " * (i % 200)) for i in range(400)]
    out += [(1000 + i, "http://a.b/", big) for i in range(30)] + [(2000 + i, None, other) for i in range(3)]
    return [*out, (3000, "not a url\r\nwith lines", None), (3001, "", ""), (3002, "http://user@x.org", "tiny"), (3003, "http://x.org", "tiny")]


def test_query_equals_brute_force(spark, tmp_path):
    data = rows()
    got = by_id(warc.op4_warc(spark, saved(spark.createDataFrame(data, PAGES).repartition(4), tmp_path, "pages")), "page_id")
    last = {}
    for i, _, html in data:
        if len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, i), i)
    assert len(got) == len(data)
    for i, _, html in data:
        b = (html or "").encode()
        first = last.get(html, i)
        assert tuple(got[i]) == (i, len(b), hashlib.sha1(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first)


def test_archives_are_warc_and_hold_the_text(spark, tmp_path):
    pages = spark.createDataFrame(rows(), PAGES)
    captures = warc.write_archives(pages, tmp_path.as_uri())
    member = captures.filter("page_id = 7").first()
    with open(member.archive.removeprefix("file://"), "rb") as f:
        f.seek(member.at)
        text = gzip.decompress(f.read(member["size"])).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("page 7 " * 7 + "\r\n\r\n") and "WARC-Target-URI: https://Host2.example.com:80/p/7?q=7#f\r\n" in text
    index = warc.write_index(captures, tmp_path.as_uri())
    assert index.agg(F.sum("lines")).first()[0] == len(rows())
    some = warc.look_up(index, pages.filter("page_id in (7, 3000, 1000)"), bodies=True)
    found = {r.page_id: r for r in some.collect()}
    assert found[7].html == "page 7 " * 7 and found[3000].html == "" and found[1000].record_type == "revisit" and found[1000].html is None
    nothing = spark.createDataFrame([(99999, "http://no.where/")], "page_id long, url string")
    assert warc.look_up(index, nothing).count() == 0


def test_keys_reverse_the_host(spark):
    urls = {"https://Blog.example.com:80/a?b#c": "com,example,blog:80)/a?b", "http://user@x.org": "org,x)", "x.org/p": "org,x)/p", "urn:page:3": "urn:page:3)", "": ")"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == urls


def test_repeats_nulls_and_empty_tables(spark, tmp_path):
    big = "z" * 1500
    pages = spark.createDataFrame([(1, "http://a/", big), (1, "http://a/", big), (2, "http://a/", big), (None, "http://a/", big), (None, None, None)], PAGES)
    folder = saved(pages, tmp_path, "pages")
    got = sorted(((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.op4_warc(spark, folder).collect()))
    assert got == sorted([("1", "revisit", "2"), ("1", "revisit", "2"), ("2", "response", "None"), ("None", "revisit", "2"), ("None", "response", "None")])
    assert warc.op4_warc(spark, saved(pages.limit(0), tmp_path, "pages")).count() == 0


def test_one_key_over_many_blocks(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "http://hot.example/", f"{i}") for i in range(2000)], PAGES)
    index = warc.write_index(warc.write_archives(pages, tmp_path.as_uri()), tmp_path.as_uri())
    assert sorted(r.page_id for r in warc.look_up(index, pages).collect()) == list(range(2000))
