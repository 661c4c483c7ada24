import math

import pytest
from millrace.llm.mixing import exponent, mix, mixed_rows, mixture, op9_temperature_mix
from pyspark.sql import functions as F

from .helpers import clashing, docs, hard_rows, prose


def sources(sizes):
    """A source of each size in documents of 20 words."""
    return [(1000 * k + i, prose(1000 * k + i, 20), "en", f"s{k}", 0) for k, n in enumerate(sizes) for i in range(n)]


def stats(spark, tokens):
    total = sum(tokens)
    return spark.createDataFrame([(f"s{k}", t, t / total) for k, t in enumerate(tokens)], "src string, tokens long, share double")


def raised(tokens, a):
    z = [(t / sum(tokens)) ** a for t in tokens]
    return [x / sum(z) for x in z]


def entropy(w):
    return -sum(x * math.log(x) for x in w)


def repeats(tokens, a):
    e = [x / t for x, t in zip(raised(tokens, a), tokens, strict=True)]
    return max(e) / min(e)


def bisect(test, rising):
    lo, hi = 0.0, 1.0
    for _ in range(60):
        m = (lo + hi) / 2
        lo, hi = (lo, m) if test(m) == rising else (m, hi)
    return hi if rising else lo


TOKENS = [100_000, 20_000, 3_000, 500]


@pytest.mark.parametrize("limit", [1.0, 2.0, 5.0, 1e9])
def test_exponent_for_repeats(spark, limit):
    want = bisect(lambda a: repeats(TOKENS, a) <= limit, True)
    assert exponent(stats(spark, TOKENS), limit) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("share", [0.5, 0.8, 0.99])
def test_exponent_for_entropy(spark, share):
    h = share * math.log(4)
    want = bisect(lambda a: entropy(raised(TOKENS, a)) >= h, False)
    assert exponent(stats(spark, TOKENS), None, h) == pytest.approx(want, abs=1e-6)


def test_budgets(spark):
    sizes = [600, 150, 40, 10]
    rows, table, n = mixture(docs(spark, sources(sizes)), max_repeats=2.0)
    assert n == 4
    found = {r["src"]: r for r in table.collect()}
    a = bisect(lambda x: repeats([20 * s for s in sizes], x) <= 2.0, True)
    want = raised([20 * s for s in sizes], a)
    assert [found[f"=s{k}"]["weight"] for k in range(4)] == pytest.approx(want, abs=1e-6)
    assert [found["=s0"]["passes"], found["=s3"]["passes"]] == pytest.approx([1, 2], abs=1e-5)
    drawn = {r[0]: r[1] for r in mix(docs(spark, sources(sizes))).groupBy("source").agg(F.sum("n_tokens")).collect()}
    for k, s in enumerate(sizes):
        budget = found[f"=s{k}"]["passes"] * 20 * s
        assert budget - 21 < drawn[f"s{k}"] <= budget + 1e-6


def test_no_document_is_lost_and_none_beyond_the_limit(spark):
    data = sources([400, 90, 20, 5])
    counts = {r["doc_id"]: r["n"] for r in mix(docs(spark, data)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {r[0] for r in data} and set(counts.values()) <= {1, 2}


def test_passes_are_block_permutations(spark):
    got = mix(docs(spark, sources([700, 700])), max_repeats=2.0, budget=3 * 28_000).orderBy("source", "epoch", "order_key").collect()
    per = {}
    for r in got:
        per.setdefault((r["source"], r["epoch"]), []).append(r)
    orders = []
    for rows in per.values():
        runs = [b for i, b in enumerate(x["block"] for x in rows) if i == 0 or rows[i - 1]["block"] != b]
        assert len(runs) == len(set(runs))  # a block is read in one piece
        slots = {}
        for x in rows:
            slots.setdefault(x["block"], []).append(x["slot"])
        assert all(s == list(range(len(s))) for s in slots.values())
        orders.append([x["doc_id"] for x in rows])
    assert len(per) == 6 and all(len(o) == 700 for o in orders)
    assert len({tuple(o) for o in orders}) == 6


def test_deterministic(spark):
    df = docs(spark, sources([300, 30]))
    assert sorted(mix(df.repartition(5)).collect()) == sorted(mix(df.coalesce(1)).collect())


def test_rows_as_often_as_drawn(spark):
    df = clashing(docs(spark, sources([300, 60, 10])), "src n_tokens tokens docs share weight passes whole blocks stop epoch block slot order_key low high want")
    got = mixed_rows(df)
    assert got.columns == df.columns
    want = {r["doc_id"]: r["n"] for r in mix(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want


def test_hard_rows(spark):
    df = clashing(docs(spark), "src n_tokens tokens docs share weight passes whole blocks stop epoch block slot order_key")
    got = mixed_rows(df)
    key = lambda r: (str(r["doc_id"]), r["text"], str(r["source"]))
    assert {key(r) for r in got.collect()} == {(str(r[0]), r[1], str(r[3])) for r in hard_rows()}
    assert mix(docs(spark, [])).collect() == [] == mixed_rows(docs(spark, [])).collect()
    wordless = [(1, None, None, "a", 0), (2, " ", None, "b", 0)]
    assert sorted((r["doc_id"], r["epoch"]) for r in mix(docs(spark, wordless)).collect()) == [(1, 0), (2, 0)]
    assert [r["epoch"] for r in mix(docs(spark, [(1, "a b", None, "only", 0)])).collect()] == [0]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op9_temperature_mix(spark, sf)
    ids = {r[0] for r in got.select("doc_id").distinct().collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert got.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
