import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm.simhash import allocate, fingerprint, linked, op5_simhash_pigeonhole, plan, simhash_components, unique_rows
from pyspark.sql import functions as F

from .helpers import clashing, docs, hard_rows, prose, union_find


def brute_print(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(brute_print(t), []).append(i)
    values = list(prints)
    links = [(a, b) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 3]
    home = union_find(values, links)
    low = {}
    for v, ids in prints.items():
        low[home[v]] = min([low.get(home[v], 1 << 62), *(i for i in ids if i is not None)])
    return {(i, f"{v:016x}", low[home[v]]) for v, ids in prints.items() for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("abAB  \t\n\x0b\x1c\x85 éİK")), max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == brute_print(text)


def test_long_fingerprint():
    text = prose(4, 70_000)
    assert fingerprint(text) == brute_print(text)
    assert fingerprint(None) == fingerprint("  ") == 0


def test_hard_rows(spark):
    rows = [r for r in hard_rows() if r[0] is not None]
    df = clashing(docs(spark, rows), "id fp component least low node n mine other own block rank")
    got = simhash_components(df).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component"]) for r in got} == brute_components([r[:2] for r in rows])
    assert simhash_components(docs(spark, [])).collect() == []
    kept = unique_rows(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components([r[:2] for r in rows])})
    assert unique_rows(docs(spark, [])).collect() == []


def near(k):
    """A text with others that are at most three bits from it."""
    base = prose(k, 400)
    return [base, *(t for t in (f"{base} end{i}" for i in range(60)) if (fingerprint(t) ^ fingerprint(base)).bit_count() <= 3)]


def test_one_row_of_a_group_stays(spark):
    a, b, *_ = near(3)
    kept = lambda rows: [tuple(r) for r in unique_rows(docs(spark, rows)).collect()]
    # Near copies without ids: one stays. An id comes before none.
    assert len(kept([(None, a, None, None, None), (None, b, None, None, None)])) == 1
    assert kept([(None, a, None, None, None), (4, b, None, None, None)]) == [(4, b, None, None, None)]
    # An id with two texts is two documents, of which each has a group of its own.
    other = prose(77, 50)
    assert sorted(kept([(1, a, "en", "s", 1), (1, other, "en", "s", 2), (0, b, "en", "s", 3)])) == [(0, b, "en", "s", 3), (1, other, "en", "s", 2)]
    # Rows that differ in other columns: the same one stays, however they come.
    rows = [(5, a, lang, source, n) for lang in ("en", None) for source in ("x", "y") for n in (1, None)]
    assert len({tuple(kept(r)) for r in (rows, rows[::-1], rows[3:] + rows[:3])}) == 1


@pytest.mark.parametrize("max_bucket", [8192, 40])
def test_links_are_exact(spark, max_bucket):
    """Prints around a few centres, so that parts collide; with small buckets that are dealt to several tasks."""
    r = random.Random(max_bucket)
    values = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(60):
            v = centre
            for _ in range(r.randrange(7)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    got = linked(spark.createDataFrame(signed, "fp long"), max_bucket=max_bucket).collect()
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in got]
    listed = list(values)
    true = [(a, b) for k, a in enumerate(listed) for b in listed[:k] if (a ^ b).bit_count() <= 3]
    assert union_find(listed, links) == union_find(listed, true)


def test_thresholds_satisfy_the_pigeonhole(spark):
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (3000, 64), dtype=np.uint8)
    bits[:, 8:16] = bits[:, :8]  # correlated bits
    fp = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
    for parts in ((2,), (3,), (4,), (2, 3, 4)):
        groups, t = plan(spark.createDataFrame([(int(x),) for x in fp], "fp long"), 3, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t) == 3 - len(groups) + 1 and all(x >= -1 for x in t)
    assert any({b, b + 8} <= set(g) for g in groups for b in range(8))


def test_costly_parts_get_small_thresholds():
    cost, t = allocate([1e9, 10.0], [[1.0] * 32, [1.0] * 32], 10_000, 3)
    assert t[0] < t[1] and sum(t) == 2


def test_large_groups_of_copies(spark):
    rows = [(i, prose(1, 50), "en", "hot", 0) for i in range(3000)] + [(5000 + i, prose(i + 9, 50), "en", "a", 0) for i in range(200)]
    got = simhash_components(docs(spark, rows)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in got) >= 3000 and len(got) > 150


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op5_simhash_pigeonhole(spark, sf).collect()} == brute_components(rows)
