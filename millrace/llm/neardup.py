"""Embedding near-dedup by sorted projection passes (operator 4).

Each pass signs every vector with 64 random hyperplanes and orders the vectors by those bits. Within each run of vectors
that share the first bits, a vector is compared, in double precision, with the `window` ones behind it; where more than
a window share them, all pairs of the run are compared in blocks. Links of all passes are united. What is left out in
dense groups is made up exactly: within each component all pairs are compared in blocks, of which only counts leave a
task.

A pair at the threshold shares those first bits in some pass with probability `recall` or more, by its angle alone: the
share found rests neither on the table's size nor on how the other vectors lie. How many passes there are, and so how
many bits, is a matter of cost, weighed by how crowded first bits are in a sample; no number is too large. A run lies
in one task, so that none ends at a seam. Equal vectors are one class from the start. Vectors that are null, zero, or
hold null or non-finite parts link with nothing; only vectors of equal length are compared; repeated ids are rows of
their own with the links of their vector.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, components, cut, table

THRESHOLD = 0.9
WINDOW = 1024
RECALL = 0.98
SEED = 11
#: Rows of a block: in components a sixteenth of them within these bounds, so that tasks are even and copies few.
BLOCK = 1024
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 256, 4096, 16
#: Rows that the cost of more passes is judged by, and the comparisons that a row costs in a further pass by itself.
SAMPLE = 4096
PASS_COST = 2000
LEAST_PASSES = 6


def prefix_bits(passes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The most first bits that a pair at the threshold shares in one of so many passes with the given probability."""
    same = 1 - math.acos(threshold) / math.pi
    return min(63, int(math.log(1 - (1 - recall) ** (1 / passes)) / math.log(same) + 1e-9))


def measured_passes(classes: DataFrame, n: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> int:
    """The number of passes that costs least, by how often rows of a sample share their first bits."""
    rows = [r["v"] for r in classes.orderBy(F.xxhash64("node", F.lit(seed))).limit(SAMPLE).select("v").collect()] if n else []
    if len(rows) < 2:
        return LEAST_PASSES
    together = np.zeros(64)
    for dim in {len(r) for r in rows}:
        x = _unit(np.array([r for r in rows if len(r) == dim], dtype=np.float64))
        for p in range(4):
            key = np.packbits(x @ np.random.default_rng([seed + 1, dim, p]).standard_normal((dim, 64)) >= 0, axis=1).view(">u8").astype(np.uint64).ravel()
            for bits in range(64):
                size = np.unique(key >> np.uint64(64 - bits) if bits else key * np.uint64(0), return_counts=True)[1].astype(float)
                together[bits] += (size * (size - 1)).sum() / 4
    # Beyond what a sample can tell, each further bit halves a run at best.
    share = np.maximum(together / (len(rows) * (len(rows) - 1)), 2.0 ** -np.arange(64))
    return cheapest_passes(n, share, threshold, recall)


def cheapest_passes(n: int, share: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """share: of all pairs of rows that share so many first bits. More passes allow for more bits; the least cost is at the fewest passes of a number of bits."""
    best = None
    for bits in range(64):
        passes = max(LEAST_PASSES, passes_for(bits, threshold, recall))
        cost = passes * (PASS_COST + share[bits] * n)
        if best is None or cost < best[0]:
            best = cost, passes
    return best[1]


def passes_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has shared its first bits with the given probability."""
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-met) - 1e-9)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _window_links(x, window, threshold):
    """Pairs (positions) at or above the threshold within the window of each other; a strip at a time, some of them further apart."""
    out = []
    for a in range(0, len(x), window):
        p, q = np.nonzero(np.triu(x[a : a + window] @ x[a : a + 2 * window].T >= threshold, 1))
        if len(p):
            out.append((p + a, q + a))
    return out


def _block_links(x, left, right, threshold):
    """Pairs (positions) at or above the threshold, one of left and one of right; in strips."""
    out = []
    for a in range(0, len(left), 512):
        p, q = np.nonzero(x[left[a : a + 512]] @ x[right].T >= threshold)
        if len(p):
            out.append((left[a + p], right[q]))
    return out


def _forest(ident, pairs):
    """Links that connect what the pairs connect, at most one for each position."""
    label = np.arange(len(ident))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = np.minimum(label, label[label])
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    x, y = ident[moved], ident[label[moved]]
    return x[x != y], y[x != y]


def _signed(classes: DataFrame, passes: int, seed: int, vectors: bool = True) -> DataFrame:
    """(pass, key, node[, v]): the bits of each vector in each pass, as a number. classes: (node, dim, v)."""

    def sign(batches):
        import pyarrow as pa

        planes = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                dims = piece.column(1).to_numpy()
                for dim in np.unique(dims):
                    mine = piece.filter(pa.array(dims == dim))
                    x = _unit(_matrix(mine.column(2)))
                    for p in range(passes):
                        if (dim, p) not in planes:
                            planes[dim, p] = np.random.default_rng([seed, int(dim), p]).standard_normal((int(dim), 64))
                        bits = np.packbits((x @ planes[dim, p] >= 0), axis=1)
                        key = bits.view(">u8").astype(np.uint64).ravel() ^ np.uint64(1 << 63)  # order of unsigned numbers as signed ones
                        cols = [pa.array(np.full(len(x), p * 65536 + int(dim), np.int64)), pa.array(key.view(np.int64)), mine.column(0)]
                        yield pa.RecordBatch.from_arrays([*cols, mine.column(2)] if vectors else cols, ["pass", "key", "node", "v"][: 3 + vectors])

    made = f", v {classes.schema['v'].dataType.simpleString()}" if vectors else ""
    return classes.mapInArrow(sign, f"pass long, key long, node long{made}")


def _groups(batches, keys: int):
    """Tables of the rows that agree in their first columns, of batches sorted by these."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        starts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[0].column(i)[0].as_py() != k[i, 0] for i in range(keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for s, e in zip(starts, starts[1:], strict=False):
            if s:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _in_blocks(rows: DataFrame, group: list[str], more: list[str]) -> DataFrame:
    """Rows with their group's number of blocks, dealt as pairs of blocks (x, y) and sorted by group, x, y, and what else is asked for."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    keys = [*group, "x", "y"]
    return rows.select(*keys, "mine", "node", "v", *more).repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *more)


def pass_links(classes: DataFrame, passes: int, window: int = WINDOW, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(a, b) from all passes: links that connect what the pairs found connect. classes: (node long, dim int, v array)."""
    bits = prefix_bits(passes, threshold, recall)
    prefix = F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long")
    crowded = _signed(classes, passes, seed, vectors=False).groupBy("pass", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    crowded = crowded.where(F.col("n") > window + 1).select("pass", "prefix", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    rows = _signed(classes, passes, seed).withColumn("prefix", prefix).join(checked_broadcast(crowded), ["pass", "prefix"], "left")
    # A run that a window holds, or a block, is in one task, in the order of its bits.
    dealt = _in_blocks(rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))), ["pass", "prefix"], ["key"])

    def compare(batches):
        import pyarrow as pa

        for g in _groups(batches, 4):
            if g.num_rows < 2:
                continue
            x, y, node, v = g.column("x")[0].as_py(), g.column("y")[0].as_py(), g.column("node").to_numpy(), _unit(_matrix(g.column("v").combine_chunks()))
            if x != y:
                mine = g.column("mine").to_numpy()
                pairs = _block_links(v, np.flatnonzero(mine == x), np.flatnonzero(mine == y), threshold)
            else:
                pairs = _window_links(v, max(window, block), threshold) if g.num_rows <= window + 1 else _block_links(v, np.arange(len(v)), np.arange(len(v)), threshold)
            if pairs:
                a, b = _forest(node, pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def link_counts(members: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(node, links): rows linked to each node within its component, by exact comparison in pairs of blocks. members: (component, node, v, weight)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = F.lit(block) if block else F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("n") / F.lit(BLOCKS))))
    dealt = _in_blocks(members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / size).cast("int")), ["component"], ["weight"])

    def count(batches):
        import pyarrow as pa

        for g in _groups(batches, 3):
            x, y = g.column("x")[0].as_py(), g.column("y")[0].as_py()
            node, weight, v, mine = g.column("node").to_numpy(), g.column("weight").to_numpy(), _unit(_matrix(g.column("v").combine_chunks())), g.column("mine").to_numpy()
            links = np.zeros(len(node), np.int64)
            left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
            for a in range(0, len(left), 512):
                strip = left[a : a + 512]
                hit = v[strip] @ v[right].T >= threshold
                if x == y:
                    hit[np.arange(len(strip)), a + np.arange(len(strip))] = False
                else:
                    links[right] += hit.T @ weight[strip]
                links[strip] += hit @ weight[right]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])

    return dealt.mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    kind = df.schema[vector_col].dataType
    part = "float" if kind.simpleString() == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{part}>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = cut(df.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v")).withColumn("class", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0).cast(part)).cast("string"))), 256))))
    classes = cut(rows.where("class is not null").groupBy("class").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")).withColumn("node", F.xxhash64("class")))
    n = classes.count()
    passes = measured_passes(classes, n, threshold, recall)
    found = cut(components(pass_links(classes.select("node", F.size("v").alias("dim"), "v"), passes, window, threshold, recall)))
    members = classes.join(found, "node").select("component", "node", "v", "weight")
    counts = link_counts(members, threshold)
    named = classes.select("class", "node", "least", "weight").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("least").alias("low"))
    by_class = named.join(lows, "component").join(counts, "node", "left").select("class", "low", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(by_class, "class", "left")
    component = F.coalesce("low", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
