"""WARC archives of pages, and the merged index of their capture histories.

Tasks write pages as compressed WARC 1.1 records to archive files; equal
payloads are stored once, later ones as revisit records. Each file has an index
run: its captures, sorted by URL key and time. The runs are external tables; a
merge task takes one range of keys from all of them and merges the sorted runs
with a loser tree, so the whole index comes out globally ordered. Reading goes
by that index: each record is fetched from its file at its offset.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfacts.llm.shared import filesystem, new_folder, settle, small_batches

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 100
#: A file is closed after so many bytes or records; its index run is sorted in memory.
FILE_BYTES, FILE_RECORDS = 256_000_000, 50_000
#: Captures that one merge task takes.
MERGE_ROWS = 1_000_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def record_id(page: object) -> str:
    """The same page always has the same record id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, then `)` and the rest; empty for null."""
    parts = r"(?is)^[a-z][a-z0-9+.-]*://(?:www\d*\.)?([^/?#:]*)(?::\d+)?([^#]*)"
    host, rest = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    known = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.coalesce(F.when(F.regexp_like(url, F.lit(parts)), known).otherwise(url), F.lit(""))


def one_line(text: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", text or "")


def record(row: dict) -> bytes:
    """One record, compressed on its own; a revisit keeps the HTTP header of the payload it stands for."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    revisit = row["refers_to"] is not None
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row['page'])}",
        f"WARC-Date: {row['captured']}", f"WARC-Target-URI: {one_line(row['url'])}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(row['refers_to'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 4, mtime=0)


def parse(data: bytes) -> dict:
    """Headers and payload facts of one record; a stored payload is hashed anew."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, v in HEADER.findall(head + b"\r\n")}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(HEADER.findall(http + b"\r\n"))[b"Content-Length"])
    named = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha256:")).hex()
    if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != named or len(payload) != length):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {
        "payload_bytes": length, "payload_digest": named, "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"], "refers": fields.get("warc-refers-to"),
        "url": fields["warc-target-uri"], "captured": fields["warc-date"], "payload": payload,
    }


def merge_runs(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Sorted runs as one, by a loser tree: each step replays one path, log2(runs) comparisons."""
    sources = [iter(r) for r in runs]
    size = max(1, len(sources))
    heads = [next(s, None) for s in sources] + [None] * (size - len(sources))

    def beats(a: int, b: int) -> bool:
        """Whether run a gives its head before run b; a run at its end loses, and equal heads go by run."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * size  # place 0 is the winner's
    for run in range(size):
        node, now = (run + size) // 2, run
        while node and losers[node] != -1:
            if beats(losers[node], now):
                losers[node], now = now, losers[node]
            node //= 2
        losers[node] = now
    while heads and heads[losers[0]] is not None:
        run = losers[0]
        yield heads[run]
        heads[run] = next(sources[run], None)
        node, now = (run + size) // 2, run
        while node:
            if beats(losers[node], now):
                losers[node], now = now, losers[node]
            node //= 2
        losers[0] = now


INDEX = "key string, captured string, page {page}, refers_to {page}, file string, offset long, length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, index, schema = None, "", 0, [], None

        def close() -> pa.RecordBatch:
            out.close()
            index.sort(key=lambda r: (r["key"], r["captured"], r["offset"]))
            made = [pa.array([r[f.name] for r in index], f.type) for f in schema]
            return pa.RecordBatch.from_arrays(made, schema=schema)

        for batch in batches:
            kind = batch.schema.field("page").type
            text, number = pa.string(), pa.int64()
            schema = pa.schema([("key", text), ("captured", text), ("page", kind), ("refers_to", kind), ("file", text), ("offset", number), ("length", number)])
            for part in range(batch.num_rows):  # a row at a time: pages can be long
                row = batch.slice(part, 1).to_pylist()[0]
                if out is None:
                    files, base = filesystem(folder)
                    files.create_dir(base, recursive=True)
                    name, at, index = f"pages-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                data = record(row)
                out.write(data)
                index.append({k: row[k] for k in ("key", "captured", "page", "refers_to")} | {"file": f"{folder}/{name}", "offset": at, "length": len(data)})
                at += len(data)
                if at >= FILE_BYTES or len(index) >= FILE_RECORDS:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(
    pages: DataFrame, folder: str, *, page: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None,
) -> DataFrame:
    """Write all pages to archives; return the settled index runs, a row per record (INDEX).

    Payloads are the texts in UTF-8, a null one is empty. Of equal payloads of
    at least LEAST_SHARED bytes the row of smallest page id is stored and the
    others are revisits of it; rows without a page id, and rows that repeat the
    stored one's id, are stored themselves. `captured` is the capture time;
    without one, or where it is null, the epoch. Only the three columns are read.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    epoch = F.timestamp_seconds(F.lit(0))
    time = F.coalesce(captured, epoch) if captured is not None else epoch
    rows = pages.select(
        F.col(page).alias("page"), F.col(url).alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"),
        url_key(F.col(url)).alias("key"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    # Only payloads that occur more than once; a digest with a third of all rows is one row here.
    shared = (
        rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy("digest")
        .agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    told = rows.join(shared, "digest", "left").withColumn("refers_to", F.when(F.col("page") != F.col("first"), F.col("first"))).drop("first")
    schema = INDEX.format(page=rows.schema["page"].dataType.simpleString())
    return settle(told.mapInArrow(_write(folder), schema), "warc-runs")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys, sorted by file and key: its slices of the runs, merged."""
    held = list(batches)
    if not held or not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    columns = [table.column(n).to_pylist() for n in ("key", "captured", "file", "offset")]
    starts = [i for i in range(table.num_rows) if i == 0 or columns[2][i] != columns[2][i - 1]] + [table.num_rows]
    slices = [((columns[0][i], columns[1][i], columns[2][i], columns[3][i], i) for i in range(a, b)) for a, b in zip(starts, starts[1:])]
    order = [r[-1] for r in merge_runs(slices)]
    yield from table.take(pa.array(order)).combine_chunks().to_batches()


def merge_index(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The runs as one index, ordered by URL key, capture time, file and offset over its partitions.

    A key range goes to one task; since file and offset take part, a URL with a
    third of all captures is spread over several.
    """
    ranges = max(runs.count() // merge_rows + 1, runs.sparkSession.sparkContext.defaultParallelism)
    dealt = runs.repartitionByRange(ranges, "key", "captured", "file", "offset")
    return dealt.sortWithinPartitions("file", "key", "captured", "offset").mapInArrow(_merge, runs.schema)


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if opened[0] != row["file"]:
                    if opened[1] is not None:
                        opened[1].close()
                    files, at = filesystem(row["file"])
                    opened = (row["file"], files.open_input_file(at))
                got = parse(opened[1].read_at(row["length"], row["offset"]))
                wanted = record_id(row["refers_to"]) if row["refers_to"] is not None else None
                if got["record_id"] != record_id(row["page"]) or got["refers"] != wanted:
                    raise ValueError(f"index and record differ at {row['file']}:{row['offset']}")
                found.append(row | got)
            names = ["page", "key", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            kind = batch.schema.field("page").type
            kinds = [kind, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), kind]
            if with_payload:
                names, kinds = [*names, "payload"], [*kinds, pa.binary()]
            made = [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=names)
        if opened[1] is not None:
            opened[1].close()

    return run


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per indexed record, read from its archive: page, key, captured, payload_bytes, payload_digest, record_type, refers_to.

    A stored payload is hashed again and must match its header; a revisit has
    length and digest of the payload it stands for, and an empty `payload`.
    Files are read front to back, in blocks of offsets that many tasks share.
    """
    kind = index.schema["page"].dataType.simpleString()
    schema = f"page {kind}, key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"
    parts = F.floor(F.col("offset") / (FILE_BYTES // 16))
    dealt = index.repartition("file", parts).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(with_payload), schema + (", payload binary" if with_payload else ""))


def archive_round_trip(spark: SparkSession, pages: DataFrame, *, page: str = "page_id") -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to) of all pages, written, merged and read back."""
    runs = write_archives(pages, new_folder(spark, "warc"), page=page)
    history = settle(merge_index(runs), "warc-index")
    found = read_archives(history)
    return found.select(F.col("page").alias(page), "payload_bytes", "payload_digest", "record_type", "refers_to")
