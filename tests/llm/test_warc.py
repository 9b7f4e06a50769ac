"""Archives, their merged index and what is read back."""

from __future__ import annotations

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from skyfacts.llm import shared, warc


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree_merges_like_a_heap(seed):
    rng = random.Random(seed)
    runs = [sorted((rng.randint(0, 30), i) for _ in range(rng.choice([0, 1, 5, 40]))) for i in range(seed * 3)]
    assert list(warc.merge_runs(runs)) == list(heapq.merge(*runs))


def expected(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= 100:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        refers = other if page is not None and other is not None and other != page else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_query(query, table):
    rows = [tuple(r) for r in table("pages").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, query("op6_warc")), key=repr) == expected(rows)


def test_awkward_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    long = "<p>é€😀\r\n\r\nWARC/1.1\r\n</p>" * 20
    texts = [None, "", "short", "short", long, long, "x" * 100, "x" * 100, "x" * 99, "x" * 99, "y" * 3_000_000]
    urls = [None, "", "http://www.A.org:80/x?q#f", "not a url", "https://b.a.org/", "http://a.org/é\r\nX: 1"]
    rows = [(i if i != 3 else None, urls[i % len(urls)], t) for i, t in enumerate(texts * 4)] + [(4, "http://z.org", long)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit("k"))
    runs = warc.write_archives(pages, shared.new_folder(spark, "w"), captured=F.timestamp_seconds(F.pmod(F.col("page_id"), F.lit(5))))
    index = warc.merge_index(runs, merge_rows=10)
    order = [(r["key"], r["captured"], r["file"], r["offset"]) for r in index.collect()]
    assert order == sorted(order) and len(order) == len(rows)
    found = warc.read_archives(index, with_payload=True).collect()
    got = sorted(((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr)
    assert got == expected(rows)
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in found if r["record_type"] == "response")
    assert warc.archive_round_trip(spark, pages.limit(0)).collect() == []


def test_url_keys(spark):
    urls = ["http://www.A.org:80/x?q#f", "https://b.a.org/", "mailto:x", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["org,a)/x?q", "org,a,b)/", "mailto:x", ""]
