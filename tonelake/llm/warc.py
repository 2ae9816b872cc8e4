"""Deterministic sharded WARC writer, and a reader for what it wrote.

Pages are cut into shards of consecutive ``page_id`` with near-equal bytes:
cells between quantiles of the ids, each parted evenly by the exact bytes in
it, so that the same table always gives the same files.
Each shard is sorted, written as one gzip member per record, and rolled to a
new file at a compressed size.  Headers and digests are made from the page
itself.  Files are written under temporary names and renamed; the manifest,
which Spark commits last, names the files that count.  Of pages with equal
payloads the one with the largest id is stored and the others refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cell_of, fresh_path, hot_keys, id_bounds, materialize, salted, spread, text_of

SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
CELLS = 4096
#: Payloads that occur more often are dealt over tasks by salts.
COPIES = 4096
EPOCH = "2000-01-01T00:00:00Z"
#: Rows that a writer unpacks, and bytes of payloads that a reader holds, at once.
ROWS, HELD_BYTES = 64, 4 << 20
_MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return " ".join(value.split()) if value else ""


def record_id(page_id: int | None, url: str | None, payload: bytes) -> str:
    name = hashlib.sha1(f"{page_id}\n{url}\n".encode("utf-8", "replace") + payload).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, payload)}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, payload)}", f"WARC-Refers-To-Date: {EPOCH}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time stamp or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def payloads_of(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, sum)`` of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(text_of("html"), "UTF-8").alias("payload"))
    return rows.withColumn("sum", F.sha1("payload"))


def revisits(rows: DataFrame, least_bytes: int = 0, copies: int = COPIES) -> DataFrame:
    """``(page_id, url, sum, revisit, refers_to, refers_url)`` of the pages that share a payload.

    Payloads are compared by SHA-1.  Of equal ones, the largest
    ``(page_id, url)`` is stored, once, and rows equal to it in both refer to
    it as well.  Payloads of fewer than ``least_bytes`` bytes are all stored.
    Only digests are shuffled; those that occur more than ``copies`` times are
    joined back under salts, so that a common payload is spread over tasks.
    """
    rows = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "url", "sum")
    keys = rows.groupBy("sum").agg(F.count("*").alias("n"), F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "url")).alias("top"))
    twice = materialize(keys.where("n > 1"), "warc-copies")
    hot = hot_keys(twice, ["sum"], copies)
    rows = salted(rows, hot, ["sum"], F.xxhash64("page_id", "url")).join(spread(twice.select("sum", "top"), hot, ["sum"]), ["sum", "salt"])
    is_top = F.col("top.page_id").eqNullSafe(F.col("page_id")) & F.col("top.url").eqNullSafe(F.col("url"))
    return rows.select("page_id", "url", "sum", (~is_top).alias("revisit"), F.when(~is_top, F.col("top.page_id")).alias("refers_to"), F.when(~is_top, F.col("top.url")).alias("refers_url"))


def sharded(rows: DataFrame, shard_bytes: int = SHARD_BYTES):
    """``(shards, place)``; ``place`` adds ``shard``: consecutive page ids with near-equal payload bytes.

    An outlying id costs its own cell only.  A cell of one id, and the null
    ids, which come last, are parted by a hash of url and payload.
    """
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("payload"))).first()
    bounds = id_bounds(rows, "page_id", n, max(1, min(CELLS, (size or 0) // shard_bytes)))
    cells = cell_of(rows, "page_id", bounds, "cell").groupBy("cell").agg(F.sum(F.octet_length("payload")).alias("bytes"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).orderBy("cell").collect()  # at most CELLS + 1 rows
    table, shards = [], 0
    for c in cells:
        parts = max(1, -(-c["bytes"] // shard_bytes))
        even = c["lo"] is not None and c["lo"] < c["hi"]
        table.append((c["cell"], shards, parts, float(c["lo"]) if even else None, max(1.0, (c["hi"] - c["lo"] + 1) / parts) if even else None))
        shards += parts
    known = rows.sparkSession.createDataFrame(table, "cell int, base long, parts long, lo double, width double")

    def place(df: DataFrame) -> DataFrame:
        # At most CELLS + 1 rows are broadcast.
        placed = cell_of(df, "page_id", bounds, "cell").join(F.broadcast(known), "cell")
        even = F.greatest(F.lit(0), F.least(F.col("parts") - 1, F.floor((F.col("page_id").cast("double") - F.col("lo")) / F.col("width"))))
        within = F.when(F.col("lo").isNull(), F.pmod(F.xxhash64("url", "sum"), F.col("parts"))).otherwise(even)
        return placed.withColumn("shard", F.col("base") + within).drop("cell", "base", "parts", "lo", "width")

    return shards, place


def write(pages: DataFrame, out: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` under ``out`` and return the manifest that was committed.

    ``out`` is a folder all executors share, as a path or URI that pyarrow
    opens.  A task that runs again writes the same bytes under the same names.
    """
    spark = pages.sparkSession
    rows = payloads_of(pages)
    shards, place = sharded(rows, shard_bytes)
    # Payloads are shuffled once: what is known of a page's copies travels beside it, as a row without payload that sorts first.
    marks = revisits(rows, least_bytes).withColumn("payload", F.lit(None).cast("binary"))
    both = rows.withColumns({"revisit": F.lit(None).cast("boolean"), "refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}).unionByName(marks)
    # One task a shard.
    rows = place(both).repartitionById(max(1, shards), F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), F.col("payload").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out)
        store.create_dir(base, recursive=True)
        state: dict = {"shard": None, "last": None, "page": None, "marks": {}}

        def close() -> list:
            if state.get("file") is None:
                return []
            state["file"].close()
            name = f"part-{state['shard'] + 1:08d}-{state['roll']:05d}.warc.gz"
            store.move(state["temp"], f"{base}/{name}")
            done = [(state["shard"], name, state["records"], state["bytes"], state["sum"].hexdigest())]
            state.update(file=None, roll=state["roll"] + 1)
            return done

        def table(done: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["shard", "file", "records", "bytes", "sha256"])

        for b in (part.slice(start, ROWS) for part in batches for start in range(0, len(part), ROWS)):
            done = []
            # Arrow's own numbers: a column with nulls stays exact.
            for shard, page_id, url, digest_, payload, revisit_, to, to_url in zip(*(c.to_pylist() for c in b.columns)):
                if shard != state["shard"]:
                    done += close()
                    state.update(shard=shard, roll=0, file=None)
                if (page_id, url) != state["page"]:
                    state.update(page=(page_id, url), marks={})
                if payload is None:
                    state["marks"][digest_] = (revisit_, to, to_url)
                    continue
                if state.get("file") is None:
                    temp = f"{base}/.tmp-{uuid.uuid4().hex}"
                    state.update(temp=temp, file=store.open_output_stream(temp, compression=None), records=0, bytes=0, sum=hashlib.sha256())
                # Rows equal to the stored one in id, url and payload come one after another; only the first is stored.
                here = (page_id, url, digest_)
                mark = state["marks"].get(digest_)
                again = mark is not None and not mark[0] and here == state["last"]
                state["last"] = here
                revisit, refers, refers_url = (True, page_id, url) if again else mark or (False, None, None)
                data = gzip_member(record(page_id, url, payload, refers, revisit, refers_url))
                state["file"].write(data)
                state["sum"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= roll_bytes:
                    done += close()
            yield table(done)
        yield table(close())

    manifest = f"{out}/manifest"
    rows.select("shard", "page_id", "url", "sum", "payload", "revisit", "refers_to", "refers_url").mapInArrow(run, _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def records(stream, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """``(offset, record)`` of each gzip member of a stream, one at a time."""
    z, parts, offset, at, data = zlib.decompressobj(31), [], 0, 0, b""
    while True:
        if not data and not (data := stream.read(size)):
            return
        parts.append(z.decompress(data))
        used = len(data) - len(z.unused_data)
        at += used
        data = z.unused_data
        if z.eof:
            yield offset, b"".join(parts)
            z, parts, offset = zlib.decompressobj(31), [], at


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload; raises where a digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:] if ": " in x)
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return fields, inner, payload


def read(manifest: DataFrame, out: str, payloads: bool = True) -> DataFrame:
    """One row per record of the manifest's files, checked against their digests.

    Without ``payloads`` that column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out)
        columns = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64()}

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(columns.values())], names=list(columns))

        number = lambda x: None if x is None else int(x)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, data in records(stream):
                        head, http, payload = parse(data)
                        full = head["WARC-Type"] == "response"
                        rows.append((number(head.get("X-Page-ID")), head.get("WARC-Target-URI"), payload if full and payloads else None, int(http["Content-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")), name, offset))
                        size += len(payload)
                        if size > HELD_BYTES:
                            yield table(rows)
                            rows, size = [], 0
                yield table(rows)

    n = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("file").repartition(n, "file").mapInArrow(run, _RECORD)


def archive(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write ``pages`` to a fresh shared folder and read the records back.

    Null html is an empty payload; a null url has no target; a null id is
    written without one and read back as null; repeated rows are records of
    their own, the first stored and the rest revisits; an empty table gives
    no files and no rows; other columns are left out.  Ids stay exact 64-bit
    numbers.
    """
    out = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, out, least_bytes), out, payloads)
