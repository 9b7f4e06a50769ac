"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best fit, longest first. All documents of one length are interchangeable, and so
are all gaps of one size, so the sweeps work on whole runs of them; a run's
documents, and its sequences, are an interval of ranks. A round is one Spark job:

1. Documents and gaps are dealt into ranges of their size, one per power of two,
   and each range is swept from the largest size down. Documents take the
   smallest gap that fits from the top of the stack of gaps seen so far. A gap
   is less than twice the length of a document in its range, so it takes one.
2. What a range has left over, documents that found nothing and gaps that
   nobody took, goes on to the ranges below. Documents take gaps of larger
   ranges, in the last place new sequences, as often as their length goes into
   them. Ranks settle who gets which: a match cuts both intervals.
3. What is left of a gap that was used is a new gap for the next round. A
   document no longer than such a gap might have taken it, so matches from
   there down are given back, and the next round starts with them.

Each round settles at least the longest documents that are left, and the result
is exactly best-fit decreasing of the single documents. Rounds are at most the
number of different lengths; 24 to 29 for texts of 1 to 20,000 words at a
capacity of 4096. Rounds pass their state on through tables in the shared folder.

The state depends on the capacity alone, not on the documents: a gap that is
used falls below half its size, so each run of gaps is used at most
log2(capacity) times, and a sweep adds at most two runs for each. A plan has
therefore at most 3 * capacity * log2(capacity) entries (150,000 at 4096). Ranks
of documents are found in Spark, over buckets of each length, and every document
finds its place by a search in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfacts.llm.shared import input_mb, new_folder, settle, small_batches
from skyfacts.llm.subwords import END_ID, encoder

CAPACITY = 4096
#: A length's documents are ranked in so many buckets at least; more come with the input.
RANK_BUCKETS = 64
MB_PER_BUCKET = 64
PLAN = [("length", np.int64), ("first", np.int64), ("sequence", np.int64), ("per", np.int64), ("offset", np.int64)]


#: What a row of a round is: a run of gaps, a match within a range, a run of documents, an entry of the plan.
GAP, MATCH, DOCUMENT, ENTRY = range(4)
#: Sequences that may be opened; an interval of ranks like that of any run.
SUPPLY = 1 << 50
#: `size` and `start` of n documents or gaps. A match or an entry has the gap's size before it too, and the first sequence.
RUN = "kind int, size long, start long, n long, gap long, sequence long, per long"
RUN_NAMES = ["kind", "size", "start", "n", "gap", "sequence", "per"]
Run = tuple[int, int, int, int, int, int, int]


def _gap(size: int, first: int, n: int) -> Run:
    return GAP, size, first, n, 0, 0, 0


def _documents(length: int, rank: int, n: int) -> Run:
    return DOCUMENT, length, rank, n, 0, 0, 0


def _from_the_largest(runs: list[Run]) -> list[Run]:
    """Largest size first; of one size gaps first, then in the order of ranks."""
    return sorted(runs, key=lambda r: (-r[1], r[0], r[2]))


def sweep_range(runs: list[Run], capacity: int) -> list[Run]:
    """Matches of documents and gaps of one power of two, and the runs that found none."""
    out: list[Run] = []
    stack: list[tuple[int, int, int]] = []
    for kind, size, start, n, *_ in _from_the_largest(runs):
        if kind == GAP:
            stack.append((size, start, n))
            continue
        while n and stack:
            gap, first, count = stack.pop()
            used = min(n, count)
            out.append((MATCH, size, start, used, gap, first, 1))
            start, n = start + used, n - used
            if count > used:
                stack.append((gap, first + used, count - used))
        if n:
            out.append(_documents(size, start, n))
    return out + [_gap(*left) for left in stack]


def hand_over(runs: list[Run], capacity: int) -> list[Run]:
    """Settled entries of the plan, and the documents and gaps of the next round, from what all ranges return."""
    out: list[Run] = []
    stack: list[tuple[int, int, int]] = []
    largest_new = 0  # of the gaps that this round makes and has no documents for

    def enter(length: int, rank: int, n: int, gap: int, first: int, sequences: int, per: int) -> int:
        """An entry of n documents; returns what it leaves of each gap."""
        nonlocal largest_new
        out.append((ENTRY, length, rank, n, gap, first, per))
        rest = gap - per * length
        if 0 < rest < length:
            out.append(_gap(rest, first, sequences))
            largest_new = max(largest_new, rest)
        return rest

    for kind, size, start, n, gap, first, _ in _from_the_largest(runs):
        if kind == GAP:
            if size > largest_new:
                stack.append((size, start, n))
            else:  # below all documents that this round settles
                out.append(_gap(size, start, n))
        elif size <= largest_new:  # a new gap may be nearer
            out.append(_documents(size, start, n))
            if kind == MATCH:
                out.append(_gap(gap, first, n))
        elif kind == MATCH:
            enter(size, start, n, gap, first, n, 1)
        else:
            while n:
                gap, first, count = stack.pop()
                per = gap // size
                used = min(count, n // per)
                if used:
                    enter(size, start, used * per, gap, first, used, per)
                    start, n, first, count = start + used * per, n - used * per, first + used, count - used
                rest = 0
                if n and count:  # fewer than fill one gap
                    rest = enter(size, start, n, gap, first, 1, n)
                    first, count, n = first + 1, count - 1, 0
                if count:
                    stack.append((gap, first, count))
                if rest >= size:
                    stack.append((rest, first - 1, 1))
    return out + [_gap(*left) for left in stack]


def _on_groups(sweep: Callable[[list[Run], int], list[Run]], capacity: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sweep(list(zip(*(group.column(n).to_pylist() for n in RUN_NAMES), strict=True)), capacity)
        columns = list(zip(*rows, strict=True)) or [()] * len(RUN_NAMES)
        kinds = [pa.int32()] + [pa.int64()] * (len(RUN_NAMES) - 1)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RUN_NAMES)

    return run


def plan_packing(lengths: DataFrame, capacity: int) -> np.ndarray:
    """The plan, in PLAN's columns and order, for a row (length, n) per length; lengths from 1 to the capacity.

    An entry (length, first, sequence, per, offset) covers the documents of the
    length from rank `first` up to the next entry's: `per` of them lie in each
    sequence from `sequence` on, one after the other from `offset`. Numbers of
    sequences may have holes. No lengths give an empty plan.
    """
    spark = lengths.sparkSession
    folder, rounds = new_folder(spark, "packing"), 0
    nothing = [F.lit(0).cast("long").alias(n) for n in RUN_NAMES[4:]]
    state = lengths.select(
        F.lit(DOCUMENT).alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long"), *nothing
    ).unionAll(spark.createDataFrame([_gap(capacity, 0, SUPPLY)], RUN))
    while True:
        ranges = F.length(F.bin("size"))  # binary digits: exact, unlike a logarithm
        swept = state.groupBy(ranges.alias("range")).applyInArrow(_on_groups(sweep_range, capacity), RUN)
        # One group: its rows are runs, whose number the capacity bounds.
        passed = swept.groupBy(F.lit(0).alias("all")).applyInArrow(_on_groups(hand_over, capacity), RUN)
        passed.write.parquet(f"{folder}/{rounds}")
        found = spark.read.schema(RUN).parquet(f"{folder}/{rounds}")
        state, rounds = found.where(F.col("kind") != ENTRY), rounds + 1
        if found.where(F.col("kind") == DOCUMENT).isEmpty():
            break
    entries = spark.read.schema(RUN).parquet(*[f"{folder}/{i}" for i in range(rounds)]).where(F.col("kind") == ENTRY)
    plan = entries.select("size", "start", "sequence", "per", F.lit(capacity) - F.col("gap")).collect()
    return np.array(sorted(map(tuple, plan)), PLAN)


def _place(plan: np.ndarray):
    """(…, length, rank) rows get their sequence and offset by search in the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = plan.value
        starts = held["length"] << 44 | held["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            own = held[np.searchsorted(starts, length << 44 | rank, side="right") - 1]
            nth = rank - own["first"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(own["sequence"] + nth // own["per"]), pa.array(own["offset"] + nth % own["per"] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = RANK_BUCKETS) -> DataFrame:
    """The pieces with `sequence_id` and `offset`; `length` (1 to the capacity) is the only column it needs.

    Sequences have gapless content from offset 0. Pieces of one length are
    ranked within buckets by a hash of the whole row, so a length that a third
    of all pieces have is spread over many tasks; equal rows are
    interchangeable. Own columns named `sequence_id`, `offset`, `rank`,
    `bucket`, `nth` or `before` are replaced. `pieces` is read three times: settle it first.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset", "rank", "bucket", "nth", "before")]
    dealt = pieces.select(*own).withColumn("bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").count()
    lengths = settle(counts.groupBy("length").agg(F.sum("count").alias("n")), "lengths")
    if not lengths.where(~F.col("length").between(1, capacity) | F.col("length").isNull()).isEmpty():
        raise ValueError("lengths must be from 1 to the capacity")
    plan = pieces.sparkSession.sparkContext.broadcast(plan_packing(lengths, capacity))  # its size is bounded by the capacity
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*own))
    ranked = dealt.withColumn("nth", nth).join(bases, ["length", "bucket"])
    ranked = ranked.select(*own, (F.col("before") + F.col("nth") - 1).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*own).schema)
    return ranked.mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long")


def _pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([END_ID], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            names, rows = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                for piece, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    names.append(name)
                    rows.append((piece, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, batch.column(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "word_bpe_49k.json",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every document.

    A document is its ids and END_ID; one longer than the capacity is cut into
    pieces of the capacity, the last of which may be shorter. A null text has
    the end id only. Null and repeated ids are kept, each row is packed. An
    empty table gives an empty result. Only the id and text columns are read.
    """
    spark: SparkSession = small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    buckets = RANK_BUCKETS + int(input_mb(docs, text_col) // MB_PER_BUCKET)
    pieces = plain.mapInArrow(_pieces(vocabulary, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return pack_pieces(settle(pieces, "pieces"), capacity, buckets).withColumnRenamed("id", id_col)
