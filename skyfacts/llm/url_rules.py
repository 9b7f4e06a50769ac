"""URL filters as a sort-merge range join of pages with allow and block rules.

A rule (host, path, verdict) fits its host, all subdomains of it, and every
path that starts with the rule's path. Written with its labels reversed, a host
is a prefix of all its subdomains, so each rule host covers one interval of the
sorted keys. Keys and rules are dealt into the same ranges of keys, sorted, and
swept once: a stack holds the rule hosts whose intervals enclose the current
key, innermost last, and each of them holds its own nested path prefixes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ROWS_PER_RANGE = 2_000_000
SAMPLE_PER_RANGE = 40
#: Ends a host in a key. It sorts before every character of a host, so a key's subdomains follow it closely.
END = "\x01"
RULES_SCHEMA = "host string, path string, verdict string"


def url_host(url):
    """What stands between the first `://` and `/`, `?`, `#` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url):
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host):
    """Labels in reverse, each closed by END: `a.org` becomes `org END a END`, a prefix of all its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), END), F.lit(END))


class PathRules:
    """The path prefixes of one host, sorted, each with the longest other one that encloses it."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        best: dict[str, str] = {}
        for path, verdict in rules:  # the same rule twice: block wins
            best[path] = "block" if "block" in (verdict, best.get(path)) else verdict
        self.paths = sorted(best)
        self.verdicts = [best[p] for p in self.paths]
        self.outer: list[int] = []
        stack: list[int] = []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return (self.paths[i], self.verdicts[i]) if i >= 0 else None


def _covers(rule_host: str, host: str) -> bool:
    return rule_host == host or bool(rule_host) and host.endswith("." + rule_host)


def _sweep(default: str):
    """One partition, sorted by range and key with rules before pages.

    A rule that covers several ranges comes again in each, which changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, list, list]] = []  # key, host, its rules, and what they make up once asked
        for batch in batches:
            found_rows = []
            columns = [batch.column(c).to_pylist() for c in ("key", "kind", "host", "path", "verdict", "page")]
            for key, kind, host, path, verdict, page in zip(*columns, strict=True):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, [], []))
                    if not stack[-1][3]:
                        stack[-1][2].append((path, verdict))
                    continue
                rule, said = None, default
                for _, rule_host, own, made in reversed(stack):
                    if not _covers(rule_host, host):
                        continue
                    if not made:
                        made.append(PathRules(own))
                    fits = made[0].longest(path)
                    if fits and (rule is None or len(rule_host + fits[0]) > len(rule)):
                        rule, said = rule_host + fits[0], fits[1]
                found_rows.append((page, host, path, rule, said))
            page_type, text = batch.schema.field("page").type, pa.string()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found_rows], page_type if i == 0 else text) for i in range(5)],
                names=["page", "host", "path", "rule", "verdict"],
            )

    return run


def _bounds(keys: DataFrame, rows_per_range: int) -> list[str]:
    """Keys between the ranges, from a sample whose size is bounded per range; any bounds give the same result."""
    rows = keys.count()
    ranges = max(rows // rows_per_range + 1, keys.sparkSession.sparkContext.defaultParallelism)
    share = min(1.0, ranges * SAMPLE_PER_RANGE / max(rows, 1))
    sample = sorted(r[0] for r in keys.sample(share, seed=1).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _range_of(bounds: list[str]):
    """Number of bounds at or below a key, in Arrow batches."""

    @F.arrow_udf("int")
    def number(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())

    return number


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url: str = "url",
    page: str = "page_id",
    default: str = "allow",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(page, host, path, rule, verdict) for every row of `pages`.

    The rule with the longest host and path wins; of equally long ones that of
    the longer host. The same rule twice: block wins. No rule: `default` and a
    null rule. A null url, or one without `://`, has empty host and path, which
    only a rule with an empty host and path fits. Repeated pages each get a
    row; a null page id is kept. Other columns of `pages` are not read. Rules
    with a null host or path count as empty there; one with a null verdict
    blocks. An empty table gives an empty result.

    A host's pages are dealt by their whole key and a hash of the page, so a
    host or a url with a third of all rows spreads over many ranges. A rule goes
    to each range that its interval meets.
    """
    located = pages.select(F.col(page).alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    keyed = located.withColumn("key", host_key(F.col("host")))
    place = F.concat("key", "path", F.lit("\x00"), F.hex(F.xxhash64("page")))
    bounds = _bounds(keyed.select(place.alias("place")), rows_per_range)
    number = _range_of(bounds)

    cover = rules.select(
        F.coalesce(F.translate("host", UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("verdict", F.lit("block")).alias("verdict"),
    ).withColumn("key", host_key(F.col("host")))
    first, last = number(F.col("key")), number(F.concat("key", F.lit("\U0010ffff")))
    cover = cover.select(
        F.explode(F.sequence(first, last)).alias("range"), "key", F.lit(0).alias("kind"), "host", "path", "verdict",
        F.lit(None).cast(located.schema["page"].dataType).alias("page"),
    )
    probes = keyed.select(
        number(place).alias("range"), "key", F.lit(1).alias("kind"), "host", "path",
        F.lit(None).cast("string").alias("verdict"), "page",
    )
    dealt = (
        cover.unionByName(probes)
        .repartition(len(bounds) + 1, "range")
        .sortWithinPartitions("range", "key", "kind")
    )
    schema = f"page {located.schema['page'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return dealt.mapInArrow(_sweep(default), schema).withColumnRenamed("page", page)

