"""Benchmark decontamination: one Aho-Corasick automaton over the items, one scan of every text.

Texts are normalised to lower-case words. Every window of consecutive item words
is a pattern of the automaton, whose letters are digits of word numbers, so a scan
reports all of them, overlapping ones too, at the places of their last words.
From there a hit is mapped to character offsets of the original text.

An automaton holds at most MOST_WINDOWS windows. A benchmark with more is dealt
by hash of the window, and the texts are scanned once per part, one part after
the other: a part's hits are written before the next part is read, so neither
the driver nor a worker ever holds two.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from skyfacts.llm.shared import settle, small_batches

WINDOW = 10
#: Distinct windows of one automaton. Each adds at most two nodes a word, so this bounds its memory, whatever the items.
MOST_WINDOWS = 100_000
#: Bytes that are not 0-9, a-z, A-Z or above 7F separate words; A-Z are lower-cased.
NORMAL = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
HITS = "struct<n_words: long, ranges: array<struct<first: long, last: long>>, items: array<string>>"
FOUND = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<start: long, end: long>>>"
FOUND_ROWS = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(text: str | None, width: int = WINDOW) -> set[bytes]:
    """The distinct windows of an item's words, single spaces between; fewer words than the width are one window."""
    words = normal_words(text or "")
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1) if words else 0)}


class Patterns:
    """Windows and the items that hold them, with each name once."""

    def __init__(self, rows: Iterable[tuple[bytes, list[str]]]) -> None:
        places: dict[str, int] = {}
        self.windows: list[bytes] = []
        self.items: list[tuple[int, ...]] = []
        for window, names in rows:
            self.windows.append(bytes(window))
            self.items.append(tuple(places.setdefault(n, len(places)) for n in names))
        self.names = list(places)


class Scanner:
    """The automaton over the patterns. A word is its number in two digits, each a character of its own alphabet.

    A node's edges are searched one by one, so the digits' base is the square
    root of the number of words. Any other word is OTHER, on no edge.
    """

    OTHER = "\0\0"

    def __init__(self, patterns: Patterns) -> None:
        import ahocorasick

        self.patterns = patterns
        words = {w: None for window in patterns.windows for w in window.split(b" ")}
        base = isqrt(len(words)) + 1
        self.letters = {w: chr(1 + at // base) + chr(1 + base + at % base) for at, w in enumerate(words)}
        self.made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.lengths: list[int] = []
        for at, window in enumerate(patterns.windows):
            letters = [self.letters[w] for w in window.split(b" ")]
            self.lengths.append(len(letters))
            self.made.add_word("".join(letters), at)
        if self.lengths:
            self.made.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, ranges of words inside a window, and the items found, of one whole text."""
        words = normal_words(text or "")
        if not words or not self.lengths:
            return len(words), [], []
        letters, other = self.letters.get, self.OTHER
        hits = [(end // 2, at) for end, at in self.made.iter("".join([letters(w, other) for w in words]))]
        ranges = merged({(last - self.lengths[at] + 1, last) for last, at in hits})
        found = {i for at in {at for _, at in hits} for i in self.patterns.items[at]}
        return len(words), ranges, sorted(self.patterns.names[i] for i in found)


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words (first, last) as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


#: The scanner of this worker process and the key of its patterns: one at a time.
_built: dict[str, Scanner] = {}


def _scanner(key: str, patterns) -> Scanner:
    if key not in _built:
        _built.clear()
        _built[key] = Scanner(patterns.value)
    return _built[key]


def _hits(patterns):
    key = uuid.uuid4().hex

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        scanner = _scanner(key, patterns)
        rows = [scanner.scan(t.as_py()) for t in texts]
        return pa.array(
            [{"n_words": n, "ranges": [{"first": a, "last": b} for a, b in r], "items": i} for n, r, i in rows],
            pa.struct([
                ("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                ("items", pa.list_(pa.string())),
            ]),
        )

    return hits


def _found(patterns):
    """What `_hits` and `_summary` give, for the only automaton: a text goes to one Python worker, once."""
    key = uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        scanner, out = _scanner(key, patterns), []
        for t in texts:
            text = t.as_py()
            n, ranges, items = scanner.scan(text)
            out.append(_told(text, n, ranges, items))
        return pa.array(out, FOUND_ROWS)

    return found


@F.arrow_udf(LongType())
def _word_count(texts: pa.Array) -> pa.Array:
    return pa.array([len(normal_words(t.as_py() or "")) for t in texts], pa.int64())


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets (start, end) in the original text of ranges of words."""
    places = [m.span() for m in WORD.finditer(text)] if ranges else []
    return [(places[a][0], places[b][1]) for a, b in ranges]


def _told(text: str | None, n_words: int, ranges: list[tuple[int, int]], items: list[str]) -> dict:
    """A row of FOUND from disjoint ranges of words and sorted items."""
    return {
        "n_words": n_words, "n_hit": sum(b - a + 1 for a, b in ranges), "items": items,
        "spans": [{"start": a, "end": b} for a, b in spans(text or "", ranges)],
    }


def _summary(texts: pa.Array, n_words: pa.Array, ranges: pa.Array, items: pa.Array) -> pa.Array:
    out = []
    for text, n, own, names in zip(texts, n_words.to_pylist(), ranges, items, strict=True):
        own = merged((r["first"], r["last"]) for r in own.as_py() or [])
        out.append(_told(text.as_py(), n, own, sorted(set(names.as_py() or []))))
    return pa.array(out, FOUND_ROWS)


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sorted(windows(text.as_py(), width))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([name] * len(own), pa.string())], names=["window", "id"])

    return run


def window_table(benchmark: DataFrame, item_col: str, item_text: str, width: int) -> DataFrame:
    """(window, ids): each distinct window of the benchmark once, settled."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("string").alias("text"))
    pairs = items.mapInArrow(_windows(width), "window binary, id string")
    return settle(pairs.groupBy("window").agg(F.collect_set("id").alias("ids")), "windows")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: Column, *,
    item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """(row, found): every row as a struct of its columns, and struct(n_words, n_hit, items, spans) of its text.

    `items` are the ids, as sorted strings, of items with a window in the text;
    `spans` the character ranges of hit words. A null or wordless text has no
    words and no hits. An item without words has no windows; one with fewer
    words than the width is one window. A null item id counts as the empty id;
    items of equal id count as one. Only the two item columns are read, and the
    columns of `docs` may have any names. Windows come to the driver one
    automaton's worth at a time, `most_windows` on average of a hash.
    """
    context = small_batches(docs.sparkSession).sparkContext
    held = window_table(benchmark, item_col, item_text, width)
    parts = max(1, -(-held.count() // most_windows))
    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), text.alias("text"))
    if parts == 1:
        return rows.select("row", _found(context.broadcast(Patterns(map(tuple, held.collect()))))(F.col("text")).alias("found"))
    hits = None
    for part in range(parts):
        own = held.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        patterns = context.broadcast(Patterns(map(tuple, own.collect())))
        found = rows.select(F.sha2("text", 256).alias("key"), _hits(patterns)(F.col("text")).alias("hit")).where(F.size("hit.items") > 0)
        # Equal texts have equal hits: one row of each is kept.
        once = settle(found.groupBy("key").agg(F.first("hit.ranges").alias("ranges"), F.first("hit.items").alias("items")), "hits")
        patterns.unpersist()
        hits = once if hits is None else hits.unionByName(once)
    every = hits.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
    joined = rows.withColumn("key", F.sha2("text", 256)).join(every, "key", "left")
    return joined.select("row", F.arrow_udf(_summary, FOUND)("text", _word_count("text"), "ranges", "items").alias("found"))
