import zlib

from millrace.llm.kdtree import kd_shards, op1_kd_tree
from pyspark.sql import functions as F

from .helpers import clashing, docs, prose


def check(rows, got, shards):
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert all(0 <= r["shard"] < shards for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hard_rows(spark):
    df = clashing(docs(spark), "id size crc node dim text_key id_key bucket rank before key w")
    rows = [tuple(r)[:5] for r in df.collect()]
    check(rows, kd_shards(df, 4).collect(), 4)
    assert kd_shards(docs(spark, []), 4).collect() == []
    check([(1, "a")], kd_shards(docs(spark, [(1, "a", None, None, None)]), 40).collect(), 40)


def test_sizes_are_near_equal(spark):
    rows = [(i, prose(i, 5 + i * 7919 % 90), "en" if i % 3 else "de", "s", 0) for i in range(4000)]
    got = kd_shards(docs(spark, rows), 40)
    check(rows, got.collect(), 40)
    sizes = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 40 + 2 * 1200


def test_equal_texts_stay_together_but_for_boundaries(spark):
    rows = [(i, prose(i // 3, 40), "en", "s", 0) for i in range(6000)]
    got = kd_shards(docs(spark, rows), 10)
    assert got.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    sizes = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert max(sizes) < 1.05 * min(sizes)
    # A third of the rows have one text: no shard may take them all.
    rows = [(i, "the same text" if i % 3 == 0 else prose(i, 8), "en", "s", 0) for i in range(3000)]
    sizes = [r[1] for r in kd_shards(docs(spark, rows), 12).groupBy("shard").agg(F.sum("size")).collect()]
    assert max(sizes) < 1.1 * min(sizes)


def test_same_whatever_the_partitions(spark):
    df = docs(spark, [(i, prose(i, 20), "en", "s", 0) for i in range(500)])
    assert sorted(kd_shards(df.repartition(7), 5).collect()) == sorted(kd_shards(df.coalesce(1), 5).collect())


def test_query(spark):
    got = op1_kd_tree(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(rows, got, 40)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
