"""Deterministic sharded WARC writer and reader (operator 10).

Records are sorted by page id within shards whose bounds come from exact byte counts of id ranges, so the same table
gives the same files however it is partitioned. Each task writes its files under names of its own attempt, rolling at
a compressed size; the driver renames what successful tasks report, then writes the manifest, itself under a temporary
name first. Readers take only the files that the manifest lists, so attempts that were lost leave nothing visible.

Of equal payloads of at least `min_bytes`, the record with the smallest page id is a response and the others revisit
it; smaller payloads are all responses. Defined results: null html is the empty payload; a null url gives
`urn:page:ID`; repeated rows of one id are written once for each row, with that id's type; an empty table gives an
empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import cut, modest_batches, shared_dir, table

DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes at which a file is closed.
ROLL = 32 << 20
#: Payload bytes of a shard, about.
SHARD = 128 << 20

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, temporary string, shard int, number int, records long, bytes long, sha256 string, first long, last long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _b32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; digest: bare base32 SHA-1 of the payload."""
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = uuid.uuid5(_NAMESPACE, f"{page_id}:{digest}:{refers_to}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{refers_to}:{digest}:None')}>",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _files(uri: str):
    """A pyarrow file system and the path within it: local files, or what pyarrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digested(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page_id, sha1 hex, size) of each record's payload."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("long").alias("size"))


def revisits(slim: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha1, refers_to) of the records that repeat an earlier payload, from digests alone."""
    again = slim.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha1").alias("d"), F.col("size").alias("z"), "first")
    met = slim.join(again, (F.col("sha1") == F.col("d")) & (F.col("size") == F.col("z"))).where(~F.col("page_id").eqNullSafe(F.col("first")))
    return met.select("page_id", "sha1", F.col("first").alias("refers_to")).distinct()


def shard_bounds(sizes: DataFrame, target: int) -> list[int]:
    """Upper ids of all shards but the last: a shard ends where the bytes of the ids up to it pass a multiple of the target.

    Ids are sorted over all executors; each adds up its own part, and only a row for each part and each shard leaves them.
    """
    by_id = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum("size").alias("size"))
    ranged = cut(by_id.repartitionByRange("page_id").sortWithinPartitions("page_id").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("size"))
    before = parts.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each part

    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = 0
        for batch in batches:
            if batch.num_rows:
                size = batch.column(1)
                upto = pc.add(pc.cumulative_sum(size), pa.scalar(held, pa.int64()))
                held = upto[-1].as_py()
                start = pc.add(pc.subtract(upto, size), batch.column(2))
                yield pa.RecordBatch.from_arrays([pc.divide(start, pa.scalar(target, pa.int64())), batch.column(0)], ["shard", "page_id"])

    # A broadcast join leaves the rows of a part in their order.
    placed = ranged.join(F.broadcast(before), "part").select("page_id", "size", "before").mapInArrow(number, "shard long, page_id long")
    ends = [r[1] for r in placed.groupBy("shard").agg(F.max("page_id")).orderBy("shard").collect()]  # a row for each shard
    return ends[:-1]


def shard_of(page_id: Column, bounds: list[int]) -> Column:
    """The number of the shard that an id falls into; null ids are in the first."""
    if not bounds:
        return F.lit(0)

    @F.pandas_udf(IntegerType())
    def search(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(np.int64), side="left"))

    return search(F.coalesce(page_id, F.lit(bounds[0])))


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, roll: int = ROLL, shard: int = SHARD) -> list[dict]:
    """Writes the archive and returns its manifest, a row for each file."""
    spark = df.sparkSession
    modest_batches(spark)
    slim = cut(digested(df, id_col, html_col))
    bounds = shard_bounds(slim.select("page_id", (F.col("size") + 512).alias("size")), shard)

    def run(batches):
        import pyarrow as pa

        files, root = _files(path)
        files.create_dir(f"{root}/_temporary", recursive=True)
        attempt = uuid.uuid4().hex
        out, at, done, mark = None, None, [], None

        def close():
            nonlocal out
            if out is not None:
                out["stream"].close()
                done.append(out)
                out = None

        for batch in batches:
            for shard_no, page_id, sha1, is_record, refers, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not is_record:
                    mark = page_id, sha1, refers
                    continue
                refers = mark[2] if mark is not None and mark[:2] == (page_id, sha1) else None
                if out is None or shard_no != at:
                    close()
                    at, number = shard_no, 0
                elif out["bytes"] >= roll:
                    number += 1
                    close()
                if out is None:
                    name = f"part-{shard_no:06d}-{number:05d}.warc.gz"
                    temporary = f"_temporary/{name}.{attempt}"
                    out = {"file": name, "temporary": temporary, "shard": shard_no, "number": number, "records": 0, "bytes": 0, "sha": hashlib.sha256(), "first": page_id, "stream": files.open_output_stream(f"{root}/{temporary}", compression=None)}
                data = gz(record(page_id, url, html.encode(), _b32(bytes.fromhex(sha1)), refers))
                out["stream"].write(data)
                out["sha"].update(data)
                out |= {"records": out["records"] + 1, "bytes": out["bytes"] + len(data), "last": page_id}
        close()
        names = ["file", "temporary", "shard", "number", "records", "bytes", "sha256", "first", "last"]
        for x in done:
            x["sha256"] = x["sha"].hexdigest()
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in done], t) for n, t in zip(names, types, strict=True)], names)

    # What a record refers to comes as a row of its own just before it, so payloads are shuffled once and joined with nothing.
    records = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.sha1(F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")).alias("sha1"),
        F.lit(True).alias("is_record"),
        F.lit(None).cast("long").alias("refers_to"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    marks = revisits(slim, min_bytes).select("page_id", "sha1", F.lit(False).alias("is_record"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = marks.unionByName(records).withColumn("shard", shard_of(F.col("page_id"), bounds)).select("shard", *records.columns)
    sent = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha1", "is_record", "url")
    wrote = sent.mapInArrow(run, MANIFEST).collect()  # a row for each file
    store, hadoop = _store(spark, path)
    manifest = []
    for r in sorted(wrote, key=lambda r: r["file"]):
        if not store.rename(hadoop(f"{path}/{r['temporary']}"), hadoop(f"{path}/{r['file']}")):
            raise OSError(f"{r['file']} could not be committed")
        manifest.append({k: v for k, v in r.asDict().items() if k != "temporary"})
    _put(spark, path, "MANIFEST.json", "".join(json.dumps(m) + "\n" for m in manifest).encode())
    store.delete(hadoop(f"{path}/_temporary"), True)
    return manifest


def _store(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _put(spark: SparkSession, path: str, name: str, data: bytes) -> None:
    store, hadoop = _store(spark, path)
    out = store.create(hadoop(f"{path}/{name}.tmp"), True)
    out.write(bytearray(data))
    out.close()
    if not store.rename(hadoop(f"{path}/{name}.tmp"), hadoop(f"{path}/{name}")):
        raise OSError(f"{name} could not be committed")


def parse(data: bytes, piece: int = 1 << 16):
    """(headers, block) of each record in a file of gzip members. Members are fed in pieces, so that what lies behind one is not copied for each."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("truncated archive")
            fed = view[at : at + piece]
            parts.append(d.decompress(fed))
            at += len(fed) - len(d.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, path: str, manifest: list[dict] | None = None) -> DataFrame:
    """The records of an archive, digests checked. Each file is at most about `roll` bytes, so one fits in a task."""
    names = [m["file"] for m in manifest] if manifest is not None else [json.loads(r[0])["file"] for r in spark.read.text(f"{path}/MANIFEST.json").collect()]
    if not names:
        return spark.createDataFrame([], RECORD)

    def run(batches):
        import pyarrow as pa

        def flush(rows):
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in parse(data.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    if f"sha1:{_b32(hashlib.sha1(block).digest())}" != h["WARC-Block-Digest"] or h["WARC-Type"] == "response" and (len(payload) != size or _b32(hashlib.sha1(payload).digest()) != digest):
                        raise ValueError(f"record {h['WARC-Record-ID']} does not match its digests")
                    rows.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, size, digest, h["WARC-Type"], int(h["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in h else None))
                    if len(rows) == 8192:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").load([f"{path}/{n}" for n in names]).select("content")
    return files.mapInArrow(run, RECORD)


def op10_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    # Files small enough that a few executors share the work on small tables as well.
    manifest = write_warc(table(spark, sf_dir, "pages"), path, roll=8 << 20, shard=16 << 20)
    return read_warc(spark, path, manifest)
