import base64
import hashlib
import random

import pytest
from millrace.llm.warc import op10_warc_shards, parse, read_warc, shard_bounds, write_warc
from pyspark.sql import functions as F

from .helpers import clashing

SCHEMA = "page_id long, url string, html string"
HARD = [
    (5, "http://a/", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (9, "http://b/\r\nX: y", "<p>same</p>"),
    (4, "http://c/", None),
    (6, None, ""),
    (7, "http://d/", "naïve \U0001f600\r\n\r\n" * 50),
    (8, "http://e/", "x" * 300_000),
    (None, "http://f/", "<p>same</p>"),
    (10, "http://g/", "y"),
    (11, "http://g/", "y"),
    (12, "http://h/", "z"),
    (12, "http://h/", "z"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= min_bytes and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        refers = first.get(p)
        refers = None if refers == i else refers
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_bytes", [0, 5, 1000])
@pytest.mark.parametrize("shard,roll", [(1 << 30, 1 << 30), (2000, 200)])
def test_round_trip(spark, tmp_path, min_bytes, shard, roll):
    path = f"file://{tmp_path}/w"
    df = clashing(pages(spark, HARD), "id node shard sha1 size first d z p refers_to is_record number")
    manifest = write_warc(df, path, min_bytes=min_bytes, shard=shard, roll=roll)
    assert got(read_warc(spark, path)) == brute(HARD, min_bytes) == got(read_warc(spark, path, manifest))
    assert sum(m["records"] for m in manifest) == len(HARD)
    assert sorted(p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith(".")) == sorted(["MANIFEST.json", *(m["file"] for m in manifest)])
    for m in manifest:
        data = (tmp_path / "w" / m["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (m["bytes"], m["sha256"])


def test_empty_table(spark, tmp_path):
    assert write_warc(pages(spark, []), f"file://{tmp_path}/w") == []
    assert read_warc(spark, f"file://{tmp_path}/w").collect() == []


def test_same_files_whatever_the_partitions(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"http://x/{i}", "".join(r.choice("abc <p>") for _ in range(r.randrange(2000)))) for i in range(300)]
    rows += [(1000 + i, f"http://y/{i}", rows[i][2]) for i in range(100)]
    manifests = [write_warc(pages(spark, rows).repartition(n), f"file://{tmp_path}/w{n}", shard=50_000, roll=10_000) for n in (1, 7)]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 10
    assert max(m["bytes"] for m in manifests[0]) < 10_000 + 3_000
    ranges = [(m["first"], m["last"]) for m in manifests[0]]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert got(read_warc(spark, f"file://{tmp_path}/w7")) == brute(rows)


def test_lost_attempts_leave_nothing_visible(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    (tmp_path / "w/_temporary").mkdir(parents=True)
    (tmp_path / "w/_temporary/part-000000-00000.warc.gz.lost").write_bytes(b"half a record")
    write_warc(pages(spark, HARD), path)
    assert got(read_warc(spark, path)) == brute(HARD)
    assert not (tmp_path / "w/_temporary").exists()


def test_records_are_well_formed(spark, tmp_path):
    write_warc(pages(spark, HARD), f"file://{tmp_path}/w")
    for p in (tmp_path / "w").glob("part-*"):
        for piece in (7, 1 << 16):
            for headers, block in parse(p.read_bytes(), piece):
                assert int(headers["Content-Length"]) == len(block)
                assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                assert "\n" not in headers["WARC-Target-URI"]
        with pytest.raises(ValueError):
            list(parse(p.read_bytes()[:-9]))


def test_changed_archives_are_found(spark, tmp_path):
    import gzip

    from millrace.llm import warc

    write_warc(pages(spark, HARD[:1]), f"file://{tmp_path}/w")
    (p,) = (tmp_path / "w").glob("part-*")
    p.write_bytes(warc.gz(gzip.decompress(p.read_bytes()).replace(b"same", b"sane")))
    (tmp_path / f"w/.{p.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="does not match"):
        read_warc(spark, f"file://{tmp_path}/w").collect()


def test_bounds(spark):
    sizes = spark.createDataFrame([(i, 1 if i % 97 else 5000) for i in range(20_000)], "page_id long, size long")
    bounds = shard_bounds(sizes, 20_000)
    assert bounds == sorted(set(bounds))
    edges = [-1, *bounds, 1 << 40]
    weights = [sizes.where(F.col("page_id").between(a + 1, b)).agg(F.sum("size")).first()[0] for a, b in zip(edges, edges[1:], strict=False)]
    assert max(weights) <= 20_000 + 5000 and sum(weights) == sizes.agg(F.sum("size")).first()[0]
    # By brute force: a shard ends with the last id that begins below its share.
    rows, at, ends = sorted((r[0], r[1]) for r in sizes.collect()), 0, {}
    for i, w in rows:
        ends[at // 20_000] = i
        at += w
    assert bounds == [ends[k] for k in sorted(ends)][:-1] == shard_bounds(sizes.repartition(13), 20_000)
    assert shard_bounds(sizes, 1 << 40) == [] == shard_bounds(sizes.where("page_id < 0"), 10)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(op10_warc_shards(spark, sf)) == brute(rows)
