"""Sharded WARC archives: sorted by page, rolled by compressed size, committed by manifest, and read back.

Pages are cut into shards by the exact sum of their bytes in order of page_id, so where a shard begins follows from the
pages alone, not from a sample or from how Spark deals them out. Each task writes its shards to files under temporary
names and tells what it wrote. Only what the finished tasks told is renamed and listed in the manifest, so a lost or
repeated task leaves nothing that a reader sees. The same pages give the same bytes under the same names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.operators import scan

from .scratch import fresh, small_batches, written

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
ROLL_BYTES = 64 << 20
#: Bytes of payload of a shard, more where there would be over SHARDS of them: where they begin is SHARDS numbers at most.
SHARD_BYTES, SHARDS = 8 << 20, 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("temporary", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _digest(x: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


def _name(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}:{nth}>"


def _record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _page_record(page_id: int | None, digest: str, nth: int, url: str | None, payload: bytes, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [] if url is None else [("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _digest(payload)), ("X-Payload-Length", str(len(payload)))]
    if refers is None:
        return _record("response", _name(page_id, digest, nth), headers, http + payload)
    return _record("revisit", _name(page_id, digest, nth), [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers, digest, 0))], http)


def _stored(rows: Iterator[pa.RecordBatch], folder: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Writes a partition's pages, shard by shard; rows of kind 0 say of the page after them which page has its payload."""
    store, root = _store(folder)
    part, told, out, sha = None, [], None, None
    planned, refers, last, nth, files = None, None, None, 0, 0

    def close() -> None:
        out.close()
        told[-1]["sha1"] = sha.hexdigest()

    for batch in rows:
        for shard, page_id, digest, kind, url, payload, to in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "url", "payload", "refers")), strict=True):
            if shard != part:
                if out is not None:
                    close()
                part, files, out = shard, 0, None
            key = (page_id, digest)
            if kind == 0:
                planned, refers = key, to
                continue
            nth, last = (nth + 1 if last == key else 0), key
            to = refers if planned == key else None
            # The first row of the page referred to is the stored one.
            record = _page_record(page_id, digest, nth, url, payload or b"", None if to == page_id and nth == 0 else to)
            if out is None or told[-1]["bytes"] + len(record) > roll:
                if out is not None:
                    close()
                file = f"pages-{part:06d}-{files:05d}.warc.gz"
                files += 1
                told.append({"temporary": f"_temporary/{uuid.uuid4().hex}-{file}", "file": file, "records": 0, "bytes": 0})
                out, sha = store.open_output_stream(f"{root}/{told[-1]['temporary']}", compression=None), hashlib.sha1()
                record = _record("warcinfo", f"<urn:x-file:{file}>", [("WARC-Filename", file), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n") + record
            out.write(record)
            sha.update(record)
            told[-1]["records"] += 1
            told[-1]["bytes"] += len(record)
    if out is not None:
        close()
    yield pa.RecordBatch.from_pylist(told, MANIFEST)


def _renamed(rows: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Moves files to their names; one that was moved by an earlier attempt is left."""
    store, root = _store(folder)
    for batch in rows:
        for row in batch.to_pylist():
            if store.get_file_info(f"{root}/{row['temporary']}").type != fs.FileType.NotFound:
                store.move(f"{root}/{row['temporary']}", f"{root}/{row['file']}")
        yield batch


def _shards(sizes: DataFrame, least: int) -> tuple[Column, int]:
    """The shard of a page_id, and how many there are: from the sum of bytes over all smaller ids, which is exact. Bounds
    are looked up in two steps, so that a row is compared with a few hundred of them."""
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = max(least, -(-total // SHARDS))
    before = scan.running(sizes.where("page_id is not null"), F.col("size"), ["page_id"], "used")
    firsts = before.select("page_id", F.floor((F.col("used") - F.col("size")) / each).alias("shard")).groupBy("shard").agg(F.min("page_id").alias("page_id"))
    bounds = sorted(r.page_id for r in firsts.collect())  # SHARDS at most
    step = max(1, math.isqrt(len(bounds)))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not runs:
        return F.lit(0), 1
    up_to = lambda array: F.size(F.filter(array, lambda b: b <= F.col("page_id")))
    run = F.greatest(up_to(F.from_json(F.lit(str([r[0] for r in runs])), "array<bigint>")) - 1, F.lit(0))
    held = F.get(F.from_json(F.lit(str(runs)), "array<array<bigint>>"), run)
    return F.when(F.col("page_id").isNull(), 0).otherwise(run * step + F.greatest(up_to(held), F.lit(1)) - 1).cast("int"), len(bounds)


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Archives of pages (page_id long, url string, html string) in folder, one record a row; returns the manifest.

    Payload is html in UTF-8, empty for null. Of records with equal payloads of revisit_bytes or more the one with the
    largest page_id is a response and the others are revisits of it; of rows that repeat that page, one is. Null
    page_ids are archived (as revisits where a known page has the payload). A null url has no target header. An empty
    table gives no files. folder is one that all executors reach by its URI.
    """
    spark = pages.sparkSession
    small_batches(spark)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    every = written(src.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")), "payloads")
    shard, n_shards = _shards(every.groupBy("page_id").agg(F.sum("size").alias("size")), shard_bytes)
    info = every.where(F.col("size") >= revisit_bytes).select("page_id", "digest")
    shared = info.groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null").drop("n")
    plan = info.join(shared, "digest").select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers").distinct()
    rows = src.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers")).unionByName(plan)
    store, root = _store(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    order = ["page_id", "digest", "kind", "url"]
    told = rows.withColumn("shard", shard).repartition(n_shards, "shard").sortWithinPartitions("shard", *order).mapInArrow(partial(_stored, folder=folder, roll=roll_bytes), "temporary string, file string, records long, bytes long, sha1 string")
    told = written(told, "told")
    told.mapInArrow(partial(_renamed, folder=folder), told.schema).write.format("noop").mode("overwrite").save()
    told.select("file", "records", "bytes", "sha1").write.parquet(f"{folder.rstrip('/')}/_manifest")
    store.delete_dir(f"{root}/_temporary")
    return spark.read.schema("file string, records long, bytes long, sha1 string").parquet(f"{folder.rstrip('/')}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, a gzip member at a time."""
    held, done = b"", False
    while not done or held:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    done = True
                    break
            parts.append(unzip.decompress(held))
            held = unzip.unused_data
        if not unzip.eof:
            if any(parts):
                raise ValueError("an archive ends within a record")
            return
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if _digest(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"damaged: {headers['WARC-Record-ID']}")
        yield headers, block


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(rows: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, root = _store(folder)
    page = re.compile(r"<urn:x-page:(none|-?\d+):[0-9a-f]{40}:\d+>")
    of = lambda x: None if x == "none" else int(x)
    for batch in rows:
        for file in batch.column("file").to_pylist():
            held: list[dict] = []
            with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                for h, block in records(stream):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    if h["WARC-Type"] == "response" and (_digest(payload) != h["WARC-Payload-Digest"] or str(len(payload)) != h["X-Payload-Length"]):
                        raise ValueError(f"damaged: {h['WARC-Record-ID']}")
                    held.append({
                        "page_id": of(page.match(h["WARC-Record-ID"])[1]), "url": h.get("WARC-Target-URI"), "payload": payload if payloads and h["WARC-Type"] == "response" else None, "payload_bytes": int(h["X-Payload-Length"]),
                        "payload_digest": base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), "record_type": h["WARC-Type"], "refers_to": of(page.match(h["WARC-Refers-To"])[1]) if "WARC-Refers-To" in h else None,
                    })
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, READ)
                        held = []
            yield pa.RecordBatch.from_pylist(held, READ)


def read_warc(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each page record of the archives that manifest lists; payload only if asked for, and of responses only.
    Digests are checked on the way; damaged archives are an error."""
    n = manifest.count()
    return manifest.select("file").repartition(max(1, n)).mapInArrow(partial(_read, folder=folder, payloads=payloads), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Pages written to archives in the shared folder, and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = fresh(spark, "warc")
    return read_warc(write_warc(pages, folder), folder).drop("url", "payload")
