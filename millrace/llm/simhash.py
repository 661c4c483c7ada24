"""SimHash near-dedup by the generalised pigeonhole (operator 5).

Fingerprints are taken once for each row and linked once for each distinct value. Bits that correlate over all
fingerprints are put into the same part. A pair at most `radius` bits apart must lie within t_i of each other in some
part i whenever the thresholds t_i (-1: the part is not probed) add up to radius - parts + 1; a dynamic programme
picks them, and the number of parts, by the candidates expected from the counts of every part's values. Each
fingerprint is put under its own value and those within t_i of it; what shares a value is compared exactly.

Links stay exact: no bucket is capped. A bucket above `max_bucket` rows is dealt out as pairs of blocks.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal rows link; an empty
table gives an empty result; other columns of the input are looked at only to choose one of rows of an id and text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, cut, modest_batches, table

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
PARTS = (2, 3, 4)
#: Rows of a bucket beyond which it is dealt to several tasks.
MAX_BUCKET = 8192
#: Cost of a comparison, where putting a row under a value costs 1.
COMPARE = 0.03


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    digest, n, ones = xxhash.xxh64_intdigest, 0, np.zeros(BITS, np.int64)
    last = max(1, len(words) - shingle + 1)
    for a in range(0, last, 1 << 16):
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(a, min(last, a + (1 << 16)))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash long, fp long: the 64 bits as a signed number)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                found = np.array([fingerprint(t, shingle) for t in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.view(np.int64))], ["id", "text_hash", "fp"])

    modest_batches(df.sparkSession)
    text = F.col(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), _text_hash(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "id long, text_hash long, fp long")


def _text_hash(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Share of each bit, absolute correlation of each two bits, and the number of fingerprints: over all of them."""

    def run(batches):
        import pyarrow as pa

        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            x = _bits(np.ascontiguousarray(batch.column(0).to_numpy())).astype(np.float32)
            both += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array(np.append(both.ravel(), n))], ["k", "v"])

    got = np.zeros(BITS * BITS + 1, np.int64)
    for k, v in fps.select("fp").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v")).collect():  # 4,097 rows whatever the input
        got[k] = v
    n = int(got[-1])
    both = got[:-1].reshape(BITS, BITS) / max(1, n)
    p = np.diag(both).copy()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs(both - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(c, 0)
    return p, c, n


def grouped(c: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of near equal size, each grown from the strongest pair left by the bit nearest to it."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        want = len(left) // (parts - k)
        rest = sorted(left)
        sub = c[np.ix_(rest, rest)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [rest[i]] if i == j else [rest[i], rest[j]]
        while len(group) < want:
            others = [b for b in rest if b not in group]
            group.append(max(others, key=lambda b: (c[b, group].mean(), -b)))
        out.append(sorted(group[:want]))
        left -= set(out[-1])
    return out


def _key(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def allocate(equal: list[float], odds: list[list[float]], n: int, radius: int) -> tuple[float, list[int]]:
    """Cheapest thresholds for one grouping. equal: pairs that agree in a part; odds: of each of its bits to differ."""
    total = radius - len(equal) + 1
    most = max(0, total + len(equal) - 1)
    best = {0: (0.0, [])}
    for pairs, own in zip(equal, odds, strict=True):
        cost, poly, probes = {-1: 0.0}, [1.0] + [0.0] * (most + 1), 0.0
        for o in own:
            for k in range(most + 1, 0, -1):
                poly[k] += poly[k - 1] * o
        for t in range(most + 1):
            probes += _choose(len(own), t)
            cost[t] = n * probes + COMPARE * pairs * sum(poly[: t + 1])
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in cost.items():
                if s + t not in step or c + more < step[s + t][0]:
                    step[s + t] = (c + more, [*chosen, t])
        best = step
    return best[total]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan(fps: DataFrame, radius: int = RADIUS, parts: tuple[int, ...] = PARTS) -> tuple[list[list[int]], list[int]]:
    """The groups of bits and their thresholds."""
    p, c, n = correlations(fps)
    choices = {m: grouped(c, m) for m in parts}
    flat = [g for m in parts for g in choices[m]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _bits(np.ascontiguousarray(batch.column(0).to_numpy()))
            for i, g in enumerate(flat):
                v, k = np.unique(_key(x, g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(k)], ["part", "value", "k"])

    counts = fps.select("fp").mapInArrow(run, "part int, value long, k long").groupBy("part", "value").agg(F.sum("k").alias("k"))
    pairs = dict.fromkeys(range(len(flat)), 0.0) | {r[0]: float(r[1]) for r in counts.groupBy("part").agg(F.sum((F.col("k") * (F.col("k") - 1)).cast("double")) / 2).collect()}  # a row for each part
    q = 2 * p * (1 - p)
    odds = q / np.maximum(1 - q, 1e-9)
    best, at = None, 0
    for m in parts:
        cost, t = allocate([pairs[at + i] for i in range(m)], [list(odds[g]) for g in choices[m]], n, radius)
        at += m
        if best is None or cost < best[0]:
            best = (cost, choices[m], t)
    return best[1], best[2]


def _compared(batches, radius: int):
    """Links within runs of equal (part, value, block), at most one for each row of a run. Rows come sorted by them."""
    import pyarrow as pa

    def links(part, value, block, own, fp):
        n = len(fp)
        label, d = np.arange(n), 1
        near = np.flatnonzero((part[:-1] == part[1:]) & (value[:-1] == value[1:]) & (block[:-1] == block[1:])) if n > 1 else np.arange(0)
        ends = np.append(np.flatnonzero(np.diff(near) != 1), len(near) - 1)
        stop = np.zeros(n, np.int64)  # one past each row's run
        if len(near):
            starts = np.append(0, ends[:-1] + 1)
            for a, b in zip(near[starts], near[ends] + 2, strict=True):
                stop[a:b] = b
        live, pairs = near, []
        while len(live):
            live = live[live + d < stop[live]]
            other = live + d
            ok = (own[live] | own[other]) & (np.bitwise_count(fp[live] ^ fp[other]) <= radius)
            if ok.any():
                pairs.append((live[ok], other[ok]))
                if sum(len(x[0]) for x in pairs) > 1 << 20:
                    pairs = [settle(label, pairs)]
            d += 1
        if not pairs:
            return None
        settle(label, pairs)
        moved = np.flatnonzero(label != np.arange(n))
        a, b = fp[moved].view(np.int64), fp[label[moved]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def settle(label, pairs):
        x, y = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        while True:
            low = np.minimum(label[x], label[y])
            before = label.copy()
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            np.minimum(label, label[label], out=label)
            if (before == label).all():
                break
        return np.flatnonzero(label != np.arange(len(label))), label[label != np.arange(len(label))]

    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        cols[4] = np.ascontiguousarray(cols[4]).view(np.uint64)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        n = len(cols[0])
        if not n:
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        at = n - int(last[::-1].argmin()) if not last.all() else 0
        held = [x[at:] for x in cols]
        if at and (out := links(*[x[:at] for x in cols])) is not None:
            yield out
    if held is not None and len(held[0]) and (out := links(*held)) is not None:
        yield out


def linked(fps: DataFrame, radius: int = RADIUS, parts: tuple[int, ...] = PARTS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect every pair within the radius."""
    groups, thresholds = plan(fps, radius, parts)

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = np.ascontiguousarray(batch.slice(at, 4096).column(0).to_numpy())
                x = _bits(fp)
                for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
                    if t < 0:
                        continue
                    key = _key(x, g)
                    for k in range(t + 1):
                        for flipped in combinations(range(len(g)), k):
                            mask = sum(1 << b for b in flipped)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(key ^ np.int64(mask)), pa.array(np.full(len(fp), k == 0)), pa.array(fp)], ["part", "value", "own", "fp"])

    rows = fps.select("fp").mapInArrow(probe, "part int, value long, own boolean, fp long")
    big = cut(rows.groupBy("part", "value").count().where(F.col("count") > max_bucket))
    if big.isEmpty():
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(F.col("count") / F.lit(max_bucket // 2)).cast("int")
        rows = rows.join(big, ["part", "value"], "left").withColumn("n", F.coalesce(blocks, F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        rows = rows.select("part", "value", "own", "fp", (F.least("mine", "other") * F.col("n") + F.greatest("mine", "other")).cast("long").alias("block"))
    keys = ["part", "value", "block"]
    dealt = rows.select(*keys, "own", "fp").repartition(*map(F.col, keys)).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: _compared(batches, radius), "a long, b long")


def _with_lows(prints: DataFrame, radius: int, parts: tuple[int, ...], max_bucket: int) -> DataFrame:
    """prints with low: the smallest (id, text_hash) reachable; null ids are the greatest. Rows of one print are one node."""
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash"))
    classes = cut(prints.groupBy("fp").agg(first.alias("least")))
    found = components(linked(classes, radius, parts, max_bucket)).withColumnRenamed("node", "fp")
    named = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = named.groupBy("component").agg(F.min("least").alias("low"))
    return prints.join(named.join(lows, "component").select("fp", "low"), "fp")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: tuple[int, ...] = PARTS, max_bucket: int = MAX_BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long, component: the smallest id reachable, null only if there is none) for each row."""
    got = _with_lows(cut(fingerprints(df, id_col, text_col, shingle)), radius, parts, max_bucket)
    return got.select(F.col("id").alias(id_col), "fp", F.col("low.id").alias("component"))


def unique_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: tuple[int, ...] = PARTS, max_bucket: int = MAX_BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, with the columns of df: the one of the smallest id, of several the one of the smallest hash of its text, then of its other columns. Null ids come last; rows with the same id and text are one, so null ids need not meet."""
    prints = _with_lows(cut(fingerprints(df, id_col, text_col, shingle).distinct()), radius, parts, max_bucket)
    found = prints.select(F.col("low.id").alias("id"), F.col("low.text_hash").alias("text_hash")).distinct()
    # Long ids and hashes take no part of the long range: where an id is null, another column says so.
    key = [F.coalesce(F.col("id"), F.lit(0)).alias("id"), F.col("id").isNull().alias("unknown"), "text_hash"]
    named = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), _text_hash(F.col(text_col)).alias("text_hash"))
    others = F.to_json(F.struct([F.col("row")[c] for c in df.columns if c != text_col] or [F.lit(0).alias("none")]))
    rank = F.row_number().over(W.partitionBy("id", "unknown", "text_hash").orderBy(F.xxhash64(others), others))
    return named.select("row", *key).join(found.select(*key), ["id", "unknown", "text_hash"], "left_semi").withColumn("rank", rank).where("rank = 1").select("row.*")


def op5_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
