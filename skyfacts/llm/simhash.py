"""Near duplicates by SimHash: fingerprints, bit-sliced comparison, connected components.

Fingerprints within the radius agree on all but `radius` of the blocks that 64
bits are cut into, so each is dealt once under every choice of agreeing blocks.
Fingerprints that share a key meet in one task, sorted. There they are compared
bit-sliced: bit plane j holds bit j of all of them, so one exclusive-or gives a
bit of the distance of thousands of pairs; carry-save counters add up the
planes, and the block is left as soon as all its counters exceed the radius.

Equal fingerprints are one fingerprint from the start, so exact copies cost
nothing. A key that more fingerprints share than one task should compare is cut
once more, by the same argument, on the bits the key leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfacts.llm.shared import settle, small_batches

BITS = 64
WORDS, SEED, RADIUS, BLOCKS = 3, 42, 2, 4
#: Shingles hashed at a time, for bounded memory on long texts.
CHUNK = 200_000
#: Fingerprints under one key that one task compares; keys with more are cut once more.
KEY_ROWS = 50_000
#: Keys of up to so many fingerprints are compared by shifts of whole planes, larger ones row by row.
SHIFTS = 64


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash over the word shingles of a whole text, repeats included: a bit is 1 if over half the hashes have it."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = max(1, len(found) - words + 1)
    first, last = starts[:size].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, size, CHUNK):
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > size, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint of a text column as a long, whose 64 bits are those of the unsigned number."""

    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), words, seed) for t in texts], np.uint64).view(np.int64))

    return made(text)


def planes(values: np.ndarray) -> np.ndarray:
    """(64, n) bits of n fingerprints, plane 0 the lowest bit."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T


def _close(differences, over, full, radius: int):
    """Counters over bit planes of differences: the pairs within the radius, as a bit mask; works on Python's long integers.

    Carry-save: each plane is added to a column of counter bits, all pairs at
    once. `over` marks the pairs that exceed the radius or do not count.
    """
    counter = [0] * (radius.bit_length())
    for plane in differences:
        for i, bit in enumerate(counter):
            counter[i], plane = bit ^ plane, bit & plane
        over |= plane  # the carry out of the counter
        beyond = 0
        for value in range(radius + 1, 1 << len(counter)):
            equal = full
            for i, bit in enumerate(counter):
                equal &= bit if value >> i & 1 else full ^ bit
            beyond |= equal
        over |= beyond
        if over == full:
            return 0
    return full ^ over


def close_in_runs(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius among neighbours that share a key; keys are sorted, no run is longer than SHIFTS.

    Row i is compared with row i + s for all i at once, for each shift s.
    """
    bits = [int.from_bytes(np.packbits(p, bitorder="little").tobytes(), "little") for p in planes(values)]
    left, right = [], []
    for shift in range(1, len(values)):
        same = keys[shift:] == keys[:-shift]
        if not same.any():
            break
        count = len(same)
        full = (1 << count) - 1
        wanted = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        close = _close(((b ^ (b >> shift)) & full for b in bits), full ^ wanted, full, radius)
        if close:
            rows = np.flatnonzero(np.unpackbits(np.frombuffer(close.to_bytes(-(-count // 8), "little"), np.uint8), bitorder="little"))
            left.append(rows)
            right.append(rows + shift)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def close_to_each(values: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows within the radius: one fingerprint against vertical planes of the rest."""
    bits = [int.from_bytes(np.packbits(p, bitorder="little").tobytes(), "little") for p in planes(values)]
    count = len(values)
    for i, value in enumerate(values.tolist()):
        rest = count - i - 1
        full = (1 << rest) - 1
        close = _close((((b >> (i + 1)) ^ (full if value >> j & 1 else 0)) & full for j, b in enumerate(bits)), 0, full, radius) if rest else 0
        if close:
            raw = np.frombuffer(close.to_bytes(-(-rest // 8), "little"), np.uint8)
            yield i, np.flatnonzero(np.unpackbits(raw, bitorder="little")) + i + 1


def spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join two components, in order."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _links(radius: int):
    """Rows (key, fp) sorted by key to links (a, b) that connect what is linked under each key."""

    def of(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        size = np.repeat(sizes, sizes)
        few = (size > 1) & (size <= SHIFTS)
        own = values[few]
        out = [(int(own[a]), int(own[b])) for a, b in spanning(*close_in_runs(keys[few], own, radius))]
        for start, count in zip(starts[sizes > SHIFTS], sizes[sizes > SHIFTS], strict=True):
            group = values[start : start + count]
            near = [(np.full(len(js), i), js) for i, js in close_to_each(group, radius)]
            if near:
                pairs = spanning(np.concatenate([x for x, _ in near]), np.concatenate([y for _, y in near]))
                out += [(int(group[a]), int(group[b])) for a, b in pairs]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])

        for batch in batches:
            held_keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            held = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(held_keys):
                continue
            done = int(np.searchsorted(held_keys, held_keys[-1]))  # the last key may go on
            if done:
                yield made(of(held_keys[:done], held[:done]))
                held_keys, held = held_keys[done:], held[done:]
        if len(held):
            yield made(of(held_keys, held))

    return run


def _mask(places: range) -> int:
    return sum(1 << p for p in places)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _keys(fp: Column, blocks: list[range], differing: int, base: Column) -> Column:
    """One key for each choice of blocks that may differ: a hash of the base, the choice and the bits outside."""
    every = list(combinations(range(len(blocks)), len(blocks) - differing))
    masks = [sum(_mask(blocks[b]) for b in kept) for kept in every]
    return F.array(*(F.xxhash64(base, F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))


def near_links(values: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column `fp`, whose components are those of all pairs within the radius.

    The comparison is exact, so keys that meet by chance only cost time. A
    hash of more than `key_rows` fingerprints is cut into keys of single bytes
    of which all but `radius` must agree; no row is left out.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    cut = [range(BITS * i // blocks, BITS * (i + 1) // blocks) for i in range(blocks)]
    fp = F.col("fp")
    keyed = values.select("fp", F.explode(_keys(fp, cut, radius, F.lit(0))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sized = keyed.join(sizes, "key")
    bytes_cut = [range(i, i + 8) for i in range(0, BITS, 8)]
    finer = F.explode(_keys(fp, bytes_cut, radius, F.col("key")))
    ready = sized.where(F.col("n") <= key_rows).select("key", "fp").unionByName(
        sized.where(F.col("n") > key_rows).select(finer.alias("key"), "fp")
    )
    dealt = ready.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(radius), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), a < b; the root is the component's smallest node.

    Alternates large and small stars until nothing changes: each node's larger
    neighbours, then its smaller ones, are linked to its smallest. Minima are
    taken by partial aggregation and joined back, so the centre of a large star
    is never gathered. Every round is settled in the shared folder.
    """
    now = settle(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()  # b > a >= m
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        now = settle(small.distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _marked(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(id, mark, fp), settled: the mark tells rows of equal id and different text apart."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return settle(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), fingerprints(text, words, seed).alias("fp")), "fingerprints")


def _rooted(marked: DataFrame, low: Column, radius: int) -> DataFrame:
    """(fp, low, root) for each distinct fingerprint, with an aggregate `low` over its rows."""
    nodes = marked.groupBy("fp").agg(low.alias("low"))
    roots = components(near_links(nodes.select("fp"), radius))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    seed: int = SEED,
) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`.

    Null, empty and wordless texts have fingerprint zero and link like any
    other. `component_id` is the smallest id reachable over links, null if all
    ids there are null. Repeated rows and ids are kept. Only the id and text
    columns are read. An empty table gives an empty result.
    """
    marked = _marked(docs, id_col, text_col, words, seed)
    grouped = _rooted(marked, F.min("id"), radius)
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    seed: int = SEED,
) -> DataFrame:
    """The rows of `docs`, all columns, of which one per group of near duplicates stays.

    That is the row of smallest id, a null id last, and of smallest text hash
    among those; of rows equal in both, any one. Columns of any name are kept
    as they are. `docs` is read twice: give a stored table.
    """
    marked = _marked(docs, id_col, text_col, words, seed)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark"))
    grouped = _rooted(marked, first, radius)
    stay = grouped.groupBy("root").agg(F.min("low").alias("low")).select("low.id", "low.mark")
    copies = marked.groupBy("id", "mark").agg(F.count("*").alias("copies"))
    same = F.col("stay.id").eqNullSafe(F.col("copies.id")) & (F.col("stay.mark") == F.col("copies.mark"))
    stay = stay.alias("stay").join(copies.alias("copies"), same).select("stay.id", "stay.mark", "copies")
    # The row travels as one struct, so no name of its columns can clash with those used here.
    row = F.struct(*[F.col(f"`{name.replace('`', '``')}`") for name in docs.columns])
    held = docs.select(F.col(id_col).alias("own"), F.xxhash64(F.col(text_col).cast("string")).alias("own_mark"), row.alias("row"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark"))
    kept = [held.join(stay.where(which).select("id", "mark"), same, "left_semi") for which in ("copies = 1", "copies > 1")]
    return kept[0].unionByName(kept[1].dropDuplicates(["own", "own_mark"])).select("row.*")
