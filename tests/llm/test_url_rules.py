"""URL rules against a check of every rule on every page."""

from __future__ import annotations

import random
import re

from skyfacts.llm import url_rules
from skyfacts.llm.queries import URL_RULES


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")


def judged(url, rules, default="allow"):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or h and host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, key=lambda f: (f[0], f[1], f[3] == "block"), default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


def test_url_query(query, table):
    got = {r["page_id"]: tuple(r)[1:] for r in query("op5_url_rules")}
    assert got == {r["page_id"]: judged(r["url"], URL_RULES) for r in table("pages").collect()}


def test_urls_of_every_kind(spark):
    rng = random.Random(5)
    hosts = ["org", "a.org", "b.a.org", "ab.org", "x-a.org", "a.org.", "", "ORG", "c.com", "é.org", "a.org:80", "1.a.org"]
    paths = ["", "/", "/a", "/a/b", "/A", "/ab", "/a?q=/b", "#f", "?x", "/a\nb", "/é"]
    urls = [f"http{s}://{h}{p}" for h in hosts for p in paths for s in ("", "s")] + [None, "", "no scheme", "://", "x://y://z"]
    rows = [(i if i % 9 else None, u, "kept", "r") for i, u in enumerate(urls + urls[:40])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = [(h.lower(), p, rng.choice(["allow", "block"])) for h in ("org", "a.org", "b.a.org", "com", "", "é.org") for p in ("", "/", "/a", "/a/b", "/é")]
    rules += [("a.org", "/a", "block"), ("a.org", "/a", "allow")]
    rules = rng.sample(rules, len(rules))
    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULES_SCHEMA), default="block", rows_per_range=20).collect()
    merged = {(h, p): "block" if any(r == (h, p, "block") for r in rules) else "allow" for h, p, _ in rules}
    every = [(h, p, v) for (h, p), v in merged.items()]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *judged(u, every, "block"))) for i, u, _, _ in rows)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], url_rules.RULES_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, rules).collect()] == [(1, "a.org", "/", None, "allow")]
    assert url_rules.judge_urls(pages.limit(0), rules).collect() == []
