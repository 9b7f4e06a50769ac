"""Exact top-k search by integer inner product in KD-trees, one per shard.

The top of one KD-tree, with median splits of a bounded sample, deals the vectors
into shards of neighbouring ones. A shard's tree is built in the task that holds
the shard: median splits of the widest dimension, and a tight bounding box for
each node. The largest inner product that a box allows bounds all rows in it, so
the traversal takes nodes best first and stops at the first bound under the
query's kth score. Queries are first answered in their own shard; the kth score
found there travels with them to all others, which return only rows that reach
it. Bounds and scores are integers, so equal scores are equal, and a box that
only reaches the kth score is still opened, for the sake of smaller ids.

Equal vectors are one query, and of their ids only the smallest few can be in a
result, so a vector with a third of all rows weighs no more than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfacts.llm.shared import settle, small_batches

#: x = floor(SCALE * component).
SCALE = 1024
#: Bytes of a shard's vectors, and rows of a leaf.
SHARD_BYTES, LEAF = 1 << 25, 128
#: Vectors that the top of the tree is split by, and its depth at most.
SAMPLE, DEPTH = 16_384, 8
#: Queries of one batch, and the shards there are at least for each core.
QUERIES, SHARDS_PER_CORE = 500, 2
#: Inner products under this are exact in doubles, whatever the order of their sums.
EXACT = 2**53
LONG = 2**63 - 1

FOUND = "query long, x array<long>, home long, own long, ids array<long>, scores array<long>"


class Split(NamedTuple):
    """One split of the top: values of a dimension up to `at` go left."""

    dim: int
    at: int
    left: Split | int
    right: Split | int


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows that take part, each once: id and vector not null, all finite, of the most frequent length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad)
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))
    return rows.select("id", F.transform("vec", lambda c: F.floor(c * SCALE)).alias("x")).distinct()


def top_splits(sample: np.ndarray, depth: int) -> Split | int:
    """The top of the tree: median splits of the widest dimension down to `depth`, with shard numbers at its ends."""
    ends = iter(range(1 << depth))

    def split(rows: np.ndarray, left: int) -> Split | int:
        if not left or len(rows) < 2 or not rows.shape[1]:
            return next(ends)
        spans = rows.max(axis=0).astype(float) - rows.min(axis=0)
        dim = int(np.argmax(spans))
        at = int(np.sort(rows[:, dim])[(len(rows) - 1) // 2])
        under = rows[:, dim] <= at
        if under.all():
            return next(ends)
        return Split(dim, at, split(rows[under], left - 1), split(rows[~under], left - 1))

    return split(sample, depth)


def end_of(tree: Split | int, x: str = "x") -> Column:
    """Number of the end of the top tree that a vector falls to."""
    if isinstance(tree, int):
        return F.lit(tree)
    return F.when(F.col(x)[tree.dim] <= tree.at, end_of(tree.left, x)).otherwise(end_of(tree.right, x))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _held(scores):
    """Scores within a long."""
    return np.clip(scores, -LONG, LONG) if getattr(scores, "dtype", np.dtype(object)) == object else scores


def _order(ids: np.ndarray, scores: np.ndarray) -> list[int] | np.ndarray:
    """Places by falling score, then by id."""
    if scores.dtype == object:
        return sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    return np.lexsort((ids, -scores))


class Tree:
    """A KD-tree of a shard's rows: boxes of all nodes, children, and the rows of each leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        low, high, self.children, spans = [], [], [], []
        # A node is a run of `order`; its children are appended when it is split.
        todo = [(0, len(ids))] if len(ids) else []
        for begin, end in todo:
            own = rows[order[begin:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            spans.append((begin, end))
            wide = high[-1].astype(float) - low[-1].astype(float)
            if end - begin <= leaf or not wide.any():
                self.children.append(None)
                continue
            half = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(own[:, int(np.argmax(wide))], half)]
            self.children.append((len(todo), len(todo) + 1))
            todo += [(begin, begin + half), (begin + half, end)]
        self.spans, self.ids, self.rows = spans, ids[order], rows[order]
        self.low, self.high = np.array(low), np.array(high)
        self.most = float(max(np.abs(rows.astype(float)).max(initial=0), 1))

    def search(self, queries: np.ndarray, count: int, reach: list[int | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query its product with itself, and the ids and scores of its best rows, of those that reach `reach`.

        Largest score first, then smallest id.
        """
        most = float(np.abs(queries.astype(float)).max(initial=0)) * self.most * max(self.rows.shape[1], 1)
        kind = np.float64 if most < EXACT else object
        asked, rows = queries.astype(kind), self.rows.astype(kind)
        above, below = np.maximum(asked, 0), np.minimum(asked, 0)
        bounds = _held(above @ self.high.astype(kind).T + below @ self.low.astype(kind).T)
        for query, bound, least in zip(asked, bounds, reach):
            yield int(_held(query @ query)), *self._best(rows, query, bound, count, least)

    def _best(self, rows: np.ndarray, query: np.ndarray, bound: np.ndarray, count: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = self.ids[:0], np.zeros(0, rows.dtype)
        todo = [(-bound[0], 0)]
        while todo and (least is None or -todo[0][0] >= least):
            _, node = heapq.heappop(todo)
            children = self.children[node]
            if children:
                for child in children:
                    if least is None or bound[child] >= least:
                        heapq.heappush(todo, (-bound[child], child))
                continue
            begin, end = self.spans[node]
            near = _held(rows[begin:end] @ query)
            good = np.ones(len(near), bool) if least is None else near >= least
            if not good.any():
                continue
            ids, scores = np.concatenate([ids, self.ids[begin:end][good]]), np.concatenate([scores, near[good]])
            best = _order(ids, scores)[:count]
            ids, scores = ids[best], scores[best]
            if len(ids) == count:
                least = scores[-1] if least is None else max(least, scores[-1])
        return ids, scores


def _searched(count: int):
    """Rows sorted by shard and kind, vectors (0) before queries (1): each query with its best rows of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, tree = None, [], [], None
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(shards) | np.diff(kinds)) + 1 if len(shards) else []
            for begin, end in zip([0, *cuts], [*cuts, len(shards)]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if shards[begin] != shard:
                    shard, ids, rows, tree = shards[begin], [], [], None
                if kinds[begin] == 0:
                    ids.append(part.column("id").to_numpy())
                    rows.append(_matrix(part.column("x")))
                    continue
                if tree is None:
                    if not ids:
                        continue  # no vector of the table is in this shard
                    tree = Tree(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [], []
                found = list(tree.search(_matrix(part.column("x")), count, part.column("reach").to_pylist()))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("x"), part.column("home"), pa.array([own for own, _, _ in found], pa.int64()),
                        pa.array([i for _, i, _ in found], longs), pa.array([[int(v) for v in s.tolist()] for _, _, s in found], longs),
                    ],
                    names=["query", "x", "home", "own", "ids", "scores"],
                )

    return run


def search_shards(shards: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """Each query (shard, id, x, home, reach) answered in its shard (shard, id, x), in batches."""
    none = F.lit(None).cast("long")
    parts = shards.select("shard", F.lit(0).alias("kind"), "id", "x", none.alias("home"), none.alias("reach")).unionByName(
        queries.select("shard", F.lit(1).alias("kind"), "id", "x", "home", "reach")
    )
    return parts.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_searched(count), FOUND)


def dealer(rows: DataFrame, dims: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What gives vectors a `shard`, and the number of shards: ends of the top tree, and parts of an end over a shard's bytes."""
    total, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    most = max(SHARD_BYTES // (8 * max(dims, 1)), LEAF)
    wanted = max(-(-total // most), min(SHARDS_PER_CORE * cores, -(-total // LEAF)))
    drawn = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toArrow().column("x").combine_chunks()
    end = end_of(top_splits(_matrix(drawn), min((wanted - 1).bit_length(), DEPTH))).cast("int")
    sizes = sorted((r["end"], r["count"]) for r in rows.groupBy(end.alias("end")).count().collect())
    pieces = [-(-size // min(most, -(-total // wanted) * 2)) for _, size in sizes]
    firsts = np.cumsum([0, *pieces]).tolist()
    ends = rows.sparkSession.createDataFrame([(e, f, p) for (e, _), f, p in zip(sizes, firsts, pieces)], "end int, first long, pieces long")

    def deal(vectors: DataFrame) -> DataFrame:
        shard = F.col("first") + F.pmod(F.xxhash64("x", "id"), F.col("pieces"))
        # 2 ** DEPTH ends at most; an end that holds none of the rows is dealt to the first shard.
        known = vectors.withColumn("end", end).join(F.broadcast(ends), "end", "left")
        return known.withColumn("shard", F.coalesce(shard, F.lit(0))).drop("end", "first", "pieces")

    return deal, firsts[-1]


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, top: int = 10
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all other rows.

    The `top` largest inner products of the vectors' floor(1024 * component),
    exact; ties go to the smaller id. Fewer, if there are not so many others.
    Ids or vectors that are null, vectors that hold null or non-finite
    components, and vectors of another length than most take no part; zero and
    empty vectors do. Rows equal in id and vector count once; with an id alone
    in common they are rows of their own. Components and scores beyond a long
    get its bound. An empty table gives an empty result. Other columns are not
    read.
    """
    spark = small_batches(vectors.sparkSession, QUERIES)
    rows = settle(usable(vectors, id_col, vec_col), "usable")
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = top + 1  # one of them may be the query's own row
    nth = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    kept = settle(rows.withColumn("nth", nth).where(F.col("nth") <= count).drop("nth"), "kept")
    deal, number = dealer(kept, len(first["x"]))
    shards = settle(deal(kept), "shards")

    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    distinct = settle(asked.select("x").distinct().withColumn("id", F.monotonically_increasing_id()), "queries")
    asked = settle(asked.join(distinct.withColumnRenamed("id", "query"), "x").select(F.col("id").alias("query_id"), "query"), "asked")
    queries = deal(distinct).withColumn("home", F.col("shard")).withColumn("reach", F.lit(None).cast("long"))
    near = settle(search_shards(shards, queries, count), "near")

    reach = F.when(F.size("scores") >= count, F.element_at("scores", -1))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))).alias("shard")
    sent = near.select(others, F.col("query").alias("id"), "x", "home", reach.alias("reach")).where("shard <> home")
    far = search_shards(shards, sent, count).where(F.size("ids") > 0)

    lists = near.unionByName(far).select("query", "own", F.explode(F.arrays_zip("ids", "scores")).alias("p"))
    lists = lists.select("query", "own", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = lists.withColumn("nth", nth).where(F.col("nth") <= count)
    best = best.groupBy("query", "own").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    pairs = F.transform("best", lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score")))
    # The query's own row, or one that reads the same; 0 if others fill the list.
    mine = F.array_position(pairs, F.struct(F.col("query_id").alias("vec_id"), F.col("own").alias("score")))
    others = F.slice(F.filter(pairs, lambda p, i: i + 1 != mine), 1, top)
    answers = asked.join(best, "query").select("query_id", F.posexplode(others).alias("at", "p"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.vec_id").alias("vec_id"), F.col("p.score").alias("score"))
