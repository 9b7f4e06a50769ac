"""Token ids as binary files of patched frame-of-reference blocks.

A file holds whole documents in order. Their ids form one sequence, cut into
blocks of BLOCK ids. A block stores its minimum, the differences to it packed at
a width that holds PERCENTILE of them, and the rest as exceptions (position,
difference). All numbers are little-endian:

    MAGIC, u64 documents, u64 ids, u64 blocks, u64 exceptions, u64 words
    u64 end of each document, in ids from the start of the file
    u32 minimum of each block | u8 width | u64 first packed word | u64 first exception
    u32 packed words
    u16 place of each exception in its block | u32 its difference

The three block arrays are the index of block starts: any block is decoded
alone. Packing is vertical: a block is LANES columns, and each column packs its
values one after the other into 32-bit words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfacts.llm.shared import filesystem, input_mb, new_folder, settle, small_batches
from skyfacts.llm.subwords import END_ID, encoder

MAGIC = b"PFR1"
BLOCK = 1024
LANES = 32
STEPS = BLOCK // LANES
PERCENTILE = 0.95
#: A file is closed after the document with which it holds so many ids.
FILE_IDS = 8_000_000
#: MB of input per range of documents; it sets how much one task holds, not what is written.
RANGE_MB = 16


def _packed_words(width: int) -> int:
    return -(-STEPS * width // 32) * LANES


def pack(deltas: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) differences below 2**width to (blocks, words)."""
    lanes = deltas.reshape(-1, STEPS, LANES)
    words = np.zeros((len(lanes), _packed_words(width) // LANES, LANES), np.uint32)
    for step in range(STEPS if width else 0):
        word, shift = divmod(step * width, 32)
        words[:, word] |= lanes[:, step] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= lanes[:, step] >> np.uint32(32 - shift)
    return words.reshape(len(lanes), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse of `pack`."""
    lanes = words.reshape(len(words), -1, LANES)
    out = np.zeros((len(lanes), STEPS, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for step in range(STEPS if width else 0):
        word, shift = divmod(step * width, 32)
        value = lanes[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | (lanes[:, word + 1] << np.uint32(32 - shift))
        out[:, step] = value & mask
    return out.reshape(-1, BLOCK)


def encode_file(documents: list[bytes]) -> bytes:
    """The file of some documents' ids, each given as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    ends = np.cumsum([len(d) // 4 for d in documents], dtype="<u8")
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    deltas = rows - low[:, None]
    place = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    kept = np.partition(deltas, place, axis=1)[:, place] if blocks else np.zeros(0, np.uint32)
    widths = np.ceil(np.log2(kept.astype(np.float64) + 1)).astype(np.uint8)
    limits = np.left_shift(np.uint64(1), widths.astype(np.uint64)) - np.uint64(1)
    patched = deltas > limits[:, None]
    at_block, at_place = np.nonzero(patched)
    exceptions = deltas[at_block, at_place]
    deltas[patched] = 0
    sizes = np.array([_packed_words(w) for w in range(33)], np.int64)[widths]
    starts = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), "<u4")
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        words[starts[own][:, None] + np.arange(_packed_words(int(width)))] = pack(deltas[own], int(width))
    counts = np.bincount(at_block, minlength=blocks)
    head = np.array([len(documents), len(ids), blocks, len(exceptions), len(words)], "<u8")
    parts = [
        head, ends, low.astype("<u4"), widths, starts.astype("<u8"), (np.cumsum(counts) - counts).astype("<u8"),
        words, at_place.astype("<u2"), exceptions.astype("<u4"),
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


@dataclass
class TokenFile:
    """A file's arrays; `block(i)` decodes one block, `ids()` all of them."""

    ends: np.ndarray
    n_ids: int
    low: np.ndarray
    widths: np.ndarray
    starts: np.ndarray
    first_exception: np.ndarray
    words: np.ndarray
    places: np.ndarray
    exceptions: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> TokenFile:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        documents, n_ids, blocks, patched, n_words = (int(x) for x in np.frombuffer(data, "<u8", 5, 4))
        at, found = 44, []
        for count, kind in (
            (documents, "<u8"), (blocks, "<u4"), (blocks, "u1"), (blocks, "<u8"), (blocks, "<u8"),
            (n_words, "<u4"), (patched, "<u2"), (patched, "<u4"),
        ):
            found.append(np.frombuffer(data, kind, count, at))
            at += found[-1].nbytes
        return cls(found[0], n_ids, *found[1:])

    def ids(self) -> np.ndarray:
        out = np.zeros((len(self.low), BLOCK), np.uint32)
        for width in np.unique(self.widths):
            own = np.flatnonzero(self.widths == width)
            out[own] = unpack(self.words[self.starts[own].astype(np.int64)[:, None] + np.arange(_packed_words(int(width)))], int(width))
        counts = np.diff(np.append(self.first_exception, len(self.exceptions)).astype(np.int64))
        out[np.repeat(np.arange(len(out)), counts), self.places] = self.exceptions
        out += self.low[:, None]
        return out.reshape(-1)[: self.n_ids]

    def block(self, i: int) -> np.ndarray:
        width = int(self.widths[i])
        first = int(self.starts[i])
        out = unpack(self.words[first : first + _packed_words(width)].reshape(1, -1), width)[0]
        last = int(self.first_exception[i + 1]) if i + 1 < len(self.low) else len(self.exceptions)
        patched = slice(int(self.first_exception[i]), last)
        out[self.places[patched]] = self.exceptions[patched]
        return (out + self.low[i])[: self.n_ids - i * BLOCK]


def _write(folder: str, vocabulary: str):
    """Sorted documents of one range (doc_id, text) to files; a row per file with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([END_ID], "<u4").tobytes()
        held: list[bytes] = []
        names: list = []
        size = 0

        def close() -> pa.RecordBatch:
            files, at = filesystem(folder)
            files.create_dir(at, recursive=True)
            name = f"tokens-{uuid.uuid4().hex}.pfr"
            with files.open_output_stream(f"{at}/{name}") as out:
                out.write(encode_file(held))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{folder}/{name}"]), pa.array([names[0]], id_type), pa.array([names], pa.list_(id_type)),
                    pa.array([size // 4], pa.int64()),
                ],
                names=["file", "first_id", "ids", "n_ids"],
            )

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(encode(text.as_py()) + end)
                names.append(name)
                size += len(held[-1])
                if size >= 4 * FILE_IDS:
                    yield close()
                    held, names, size = [], [], 0
        if held:
            yield close()

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "word_bpe_49k.json",
) -> DataFrame:
    """Write all texts' ids, each document closed by END_ID, in ascending order of id; return the settled list of files.

    (shard, file, ids, n_ids, start): `start` counts the ids of all files before.
    A null text has the end id only; null ids come first; rows with equal ids
    stand in order of their text's hash, so an id with a third of all rows
    spreads over several ranges. An empty table gives no files. Only the id and
    text columns are read. Each attempt of a task writes files of its own name,
    and the settled list names those of the attempt that counted.
    """
    small_batches(docs.sparkSession)
    ranges = max(int(input_mb(docs, text_col) // RANGE_MB) + 1, docs.sparkSession.sparkContext.defaultParallelism)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Without adaptive coalescing: the number of the range is the order of the files.
    ordered = (
        plain.withColumn("place", F.xxhash64("text"))
        .repartitionByRange(ranges, F.col("id").asc_nulls_first(), "place")
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "place")
        .select("id", "text")
    )
    kind = plain.schema["id"].dataType.simpleString()
    files = ordered.mapInArrow(_write(folder, vocabulary), f"file string, first_id {kind}, ids array<{kind}>, n_ids long")
    files = settle(files.withColumn("shard", F.monotonically_increasing_id()), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return files.select("shard", "file", "ids", "n_ids").join(starts, "shard")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, at = filesystem(row["file"])
            with files.open_input_stream(at) as data:
                held = TokenFile.parse(data.read())
            ids = held.ids().astype("<u4")
            ends = held.ends.astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(ids[a:b].data) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                    pa.array(begins + row["start"]), pa.array(ends - begins), pa.array(sums, pa.int64()),
                ],
                names=["id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the listed files, a file at a time."""
    kind = files.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long"
    few = files.select("file", "ids", "start").repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return few.mapInArrow(_read, schema).withColumnRenamed("id", id_col)


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the ids of `docs` to a new folder of the shared one, and read them back."""
    return read_digests(write_tokens(docs, new_folder(spark, "tokens")))
