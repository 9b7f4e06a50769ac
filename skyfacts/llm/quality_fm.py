"""Text quality by a factorisation machine over hashed words, structure and length.

Every feature has a weight and a short vector; each pair of features interacts
with the inner product of its vectors. A text is scored in time linear in its
features, since the sum over pairs is half of (sum of vectors, squared) minus
(sum of squared vectors), per dimension.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfacts.llm.shared import PARTS, draw, fold, input_mb, settle, small_batches

WORD_BITS, RANK = 12, 6
#: Structure features are shares cut at these bounds, each a feature of its own: a step function of the share.
SHARES = (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95)
#: Labelled rows that are learned from at most, bytes of a label's, and those drawn before longer ones; scoring reads everything.
SAMPLE, SAMPLE_BYTES, SHORT_BYTES = 8000, 64_000_000, 20_000
#: MB of documents whose labelled keys are written as one file, 24 bytes a document.
MB_A_FILE = 64
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.1, 1e-5
#: Share of the squared length of a text's features that goes to words, structure and length.
WORD_SHARE, SHAPE_SHARE = 0.4, 0.6
SHAPES = 12
MARK, DIGIT = re.compile(r"[^\w\s]"), re.compile(r"\d")
BASE = 1 << WORD_BITS
WIDTH = BASE + SHAPES * (len(SHARES) + 1) + 24


def shapes(text: str, words: list[str], counts: Counter) -> list[float]:
    """Shares from 0 to 1 that describe how a text is built; an empty text has none of anything."""
    upper = titled = ended = symbols = marked = letters = 0
    for word, n in counts.items():
        letters += n * len(word)
        if word.isupper():
            upper += n
        elif word[0].isupper():
            titled += n
        if word[-1].isalpha():
            ended += n
        elif len(word) > 1 and not word[-1].isalnum() and not word[-2].isalnum():
            marked += n
        if not any(map(str.isalpha, word)):
            symbols += n
    n, size = max(len(words), 1), max(len(text), 1)
    lines = text.split("\n")
    repeated = sum(map(operator.eq, words, words[1:]))
    shares = [x / n for x in (len(counts), max(counts.values(), default=0), repeated, upper, titled, ended, symbols, marked)]
    return shares + [
        len(MARK.findall(text)) / size, len(DIGIT.findall(text)) / size, 1 - len(set(lines)) / len(lines), min(1.0, letters / n / 20),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text's features: words by hash, steps of structure, one step of its length."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    own = Counter(zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & (BASE - 1) for w in counts)
    index, value = list(own), [1.0 + math.log(c) for c in own.values()]
    norm = math.sqrt(sum(v * v for v in value)) or 1.0
    value = [v * math.sqrt(WORD_SHARE) / norm for v in value]
    for i, share in enumerate(shapes(text, words, counts)):
        index.append(BASE + i * (len(SHARES) + 1) + sum(share >= b for b in SHARES))
        value.append(np.sqrt(SHAPE_SHARE / (SHAPES + 1)))
    index.append(BASE + SHAPES * (len(SHARES) + 1) + min(23, len(text).bit_length()))
    value.append(np.sqrt(SHAPE_SHARE / (SHAPES + 1)))
    return np.array(index, np.int64), np.array(value, np.float32)


@dataclass
class Machine:
    """A fitted factorisation machine."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log odds of label 1 for rows of (indices, values)."""
        if not rows:
            return np.zeros(0)
        index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        scaled = self.vectors[index] * value[:, None]
        sums, squares = np.add.reduceat(scaled, starts), np.add.reduceat(scaled * scaled, starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + (sums * sums - squares).sum(axis=1) / 2


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Machine:
    """Logistic loss, mini-batches with AdaGrad steps."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32))
    truth = np.array(labels, np.float64)
    if len(set(labels)) < 2:  # nothing to tell apart
        machine.vectors[:] = 0
        machine.bias = 2.0 if labels and labels[0] else -2.0 if labels else 0.0
        return machine
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, RANK), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            own = [rows[i] for i in batch]
            odds = machine.margins(own)
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - truth[batch]) / len(batch)
            index, value = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
            sizes = np.array([len(i) for i, _ in own])
            starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(own)), sizes)
            scaled = machine.vectors[index] * value[:, None]
            sums = np.add.reduceat(scaled, starts)
            step = (error[doc] * value).astype(np.float32)
            used, at_used = np.unique(index, return_inverse=True)
            grad_w, grad_v = np.zeros(len(used), np.float32), np.zeros((len(used), RANK), np.float32)
            np.add.at(grad_w, at_used, step)
            np.add.at(grad_v, at_used, step[:, None] * (sums[doc] - scaled))
            grad_w += DECAY * machine.weights[used]
            grad_v += DECAY * machine.vectors[used]
            seen_w[used] += grad_w * grad_w
            seen_v[used] += grad_v * grad_v
            machine.weights[used] -= RATE * grad_w / np.sqrt(seen_w[used])
            machine.vectors[used] -= RATE / 2 * grad_v / np.sqrt(seen_v[used])
            seen_b += error.sum() ** 2
            machine.bias -= RATE * float(error.sum() / np.sqrt(seen_b))
    return machine


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str,
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, short_bytes: int = SHORT_BYTES,
) -> Machine:
    """Fit on a bounded sample of labelled rows: `sample` rows, and of each label `sample_bytes` at most.

    Labels keep their shares of the labelled rows. Rows of up to `short_bytes`
    are drawn by the hash of id and text; a label that has too few of them gets
    longer ones, from the shortest up, so that none is left out for its length.
    Rows with a null or other label are not drawn. Keys are drawn before texts
    are read, and no text is shuffled.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"key": F.xxhash64("id", "text"), "size": F.octet_length("text")})
    marked = keyed.select("key", "id", "size").join(marks.groupBy("id").agg(F.max("label").alias("label")), "id")
    rows = marked.groupBy("key", "size").agg(F.max("label").alias("label"))
    rows = settle(rows.coalesce(max(PARTS, int(input_mb(docs, text_col) / MB_A_FILE))), "labelled")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return fit([], [])
    shares = {label: max(1, min(n, sample * n // sum(counts.values()))) for label, n in counts.items()}
    drawn = [mark for label, most in sorted(shares.items()) for mark in draw(rows.where(F.col("label") == label), "label", most, sample_bytes, short_bytes)]
    wanted = docs.sparkSession.createDataFrame(drawn, "key long, label int")  # `sample` rows
    found = keyed.join(F.broadcast(wanted), "key").select("key", "label", "text").dropDuplicates(["key"]).collect()
    found.sort(key=lambda r: r["key"])
    return fit([features(r["text"]) for r in found], [r["label"] for r in found])


def quality(docs: DataFrame, machine: Machine, text: Column) -> Column:
    """The score from 0 to 1 of a text column, higher for label 1; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(texts: pa.Array) -> pa.Array:
        odds = held.value.margins([features(t.as_py()) for t in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())

    return F.arrow_udf(run, "double")(text)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 3, held: int = 1,
) -> DataFrame:
    """(id, held_out, score, predicted) per row; labels of fold `held` of the ids are not learned from.

    Null and empty texts get the score of an empty text. With labels of one
    kind only, every score says that label; without labels, 0.5. Repeated rows
    and null ids are kept. An empty table gives an empty result. Other columns
    are not read.
    """
    outside = fold(F.col(id_col), folds) == held
    machine = train(docs.where(~outside), labels, id_col=id_col, text_col=text_col, label_col=label_col)
    text = F.col(text_col).cast("string")
    found = docs.select(F.col(id_col), outside.alias("held_out"), quality(docs, machine, text).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
