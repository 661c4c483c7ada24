"""Sharding by a K-d tree (operator 1).

A node that owes k shards is split where the bytes reach k1/k of its own, along its widest metadata dimension
(extent as a share of the whole table's). The place is a weighted quantile found by narrowing histograms: each pass
sums bytes in at most `BINS` bins for each open node, so the driver sees a bounded table whatever the input. Ties of a
coordinate are ordered by the hash of the text and then of the id, so equal texts stay together unless a boundary
must cut through a group of them that is heavy beside a shard.

Defined results: a null text has 16 bytes and checksum 0; null metadata is the least value; repeated rows get slots of
their own next to each other; an empty table gives no rows; clashing names of other columns do not matter, since only
the named ones are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 40
OVERHEAD = 16
BINS = 2048
#: A boundary is precise enough within this share of a shard.
TOLERANCE = 0.002
#: Equal texts of at most this share of a shard stay together; heavier groups are cut where a boundary falls.
GROUP_SHARE = 0.05
#: Rows of a slot bucket, about.
BUCKET_ROWS = 20_000


def prefix_number(c: F.Column) -> F.Column:
    """The first 7 bytes of a text as a number: an order-keeping coordinate."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long"), F.lit(0).cast("long"))


def _positive(c: F.Column) -> F.Column:
    return F.shiftrightunsigned(c, 1)


def dimensions(df: DataFrame, text_col: str = "text") -> dict[str, F.Column]:
    """Metadata that equal texts share: language and length (of its logarithm). A caller may give others, such as the source."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD
    return {"lang": prefix_number(F.col("lang")), "length": F.floor(F.log2(size.cast("double")) * F.lit(float(1 << 40))).cast("long")}


class _Split:
    """The search for one node's boundary: key components are compared one after the other."""

    def __init__(self, node, shards, weight, dim, low, high):
        self.node, self.shards, self.weight, self.dim = node, shards, weight, dim
        self.left = shards // 2
        self.want = weight * self.left / shards
        self.fixed, self.low, self.high, self.below = [], low, high, 0
        self.done = False

    def search(self) -> tuple:
        """node, dimension, component, what the components before it equal, interval and bin width."""
        f = [*self.fixed, 0, 0]
        return self.node, self.dim, len(self.fixed), f[0], f[1], self.low, self.high, (self.high - self.low) // BINS + 1

    def narrow(self, bins, tolerance, group):
        """bins: (least, most, weight) in order. Keeps the one that holds the boundary, or ends. group: weight up to which equal texts are not cut."""
        at = self.below
        for least, most, w in bins:
            if at + w >= self.want:
                break
            at += w
        over, under = at + w - self.want, self.want - at
        whole = len(self.fixed) == 2 or len(self.fixed) == 1 and w <= group
        if least == most and whole or min(over, under) <= tolerance:
            # The whole bin goes to the nearer side.
            self.done, self.bound = True, [*self.fixed, most if over <= under else least - 1]
        elif least == most:
            self.fixed.append(least)
            self.low, self.high, self.below = 0, (1 << 63) - 1, at
        else:
            self.low, self.high, self.below = least, most, at

    def boundary(self, left: int, right: int) -> tuple:
        b = [*self.bound, 0, 0]
        return self.node, self.dim, len(self.bound), b[0], b[1], b[2], left, right


def _rows(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table of fewer rows than there are shards, sent with the plan."""
    values = ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"select * from values {values} as t({names})"))


def kd_shards(df: DataFrame, shards: int = SHARDS, dims: Callable[[DataFrame], dict[str, F.Column]] = dimensions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, n_splits): every row in one of the shards, sizes near equal."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    coords = dims(df)
    base = cut(
        df.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("crc"),
            _positive(F.xxhash64(text)).alias("text_key"),
            _positive(F.xxhash64(F.lit(7), F.col(id_col))).alias("id_key"),
            *[c.alias(f"dim_{k}") for k, c in coords.items()],
        )
    ).withColumn("node", F.lit(0).cast("long"))
    names = [f"dim_{k}" for k in coords]
    extents = lambda d: d.groupBy("node").agg(F.sum("size").alias("w"), *[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]).collect()  # noqa: E731  a row for each node
    coordinate = F.element_at(F.array(*names), (F.col("dim") + 1).cast("int"))
    open_nodes, whole, n_next, tolerance, group, shard_of = {0: shards}, None, 1, 0, 0, {}
    while open_nodes:
        splits = {}
        for r in extents(base):
            k = open_nodes.get(r["node"], 1)
            spans = [r[f"max_{c}"] - r[f"min_{c}"] for c in names]
            if whole is None:
                whole, tolerance, group = [max(1, s) for s in spans], TOLERANCE * r["w"] / shards, GROUP_SHARE * r["w"] / shards
            if k > 1:
                widest = max(range(len(names)), key=lambda i: (spans[i] / whole[i], -i))
                c = names[widest]
                splits[r["node"]] = _Split(r["node"], k, r["w"], widest, r[f"min_{c}"], r[f"max_{c}"])
        while live := [s for s in splits.values() if not s.done]:
            asked = _rows(df.sparkSession, [x.search() for x in live], "node, dim, component, f0, f1, low, high, width")
            place = F.when(F.col("component") == 0, coordinate).when(F.col("component") == 1, F.col("text_key")).otherwise(F.col("id_key"))
            met = ((F.col("component") < 1) | (coordinate == F.col("f0"))) & ((F.col("component") < 2) | (F.col("text_key") == F.col("f1"))) & F.col("key").between(F.col("low"), F.col("high"))
            got = base.join(asked, "node").withColumn("key", place).where(met).groupBy("node", F.expr("(key - low) div width").alias("bin")).agg(F.sum("size").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"))
            rows: dict[int, list] = {}
            for r in got.collect():  # at most BINS rows for each of fewer than `shards` nodes
                rows.setdefault(r["node"], []).append((r["least"], r["most"], r["w"]))
            for s in live:
                s.narrow(sorted(rows[s.node]), tolerance, group)
        # Nodes with rows were split; one that owes shards but has no rows left them empty.
        if not splits:
            break
        following, cuts = {}, []
        for i, x in splits.items():
            a, b = n_next, n_next + 1
            n_next += 2
            following |= {a: x.left, b: x.shards - x.left}
            cuts.append(x.boundary(a, b))
            shard_of |= {a: shard_of.get(i, 0), b: shard_of.get(i, 0) + x.left}
        bounds = _rows(df.sparkSession, cuts, "node, dim, length, b0, b1, b2, to_left, to_right")
        rest = (F.col("length") == 2) | (F.col("id_key") <= F.col("b2"))
        inner = (F.col("length") == 1) | (F.col("text_key") < F.col("b1")) | ((F.col("text_key") == F.col("b1")) & rest)
        goes = (coordinate < F.col("b0")) | ((coordinate == F.col("b0")) & inner)
        base = base.join(bounds, "node", "left").withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).when(goes, F.col("to_left")).otherwise(F.col("to_right"))).select(*base.columns)
        open_nodes = {i: k for i, k in following.items() if k > 1}
    numbers = F.create_map(*[F.lit(x).cast("long") for pair in (shard_of or {0: 0}).items() for x in pair])
    final = cut(base.select("id", "size", "crc", "text_key", numbers[F.col("node")].alias("shard")))
    total = final.count()
    buckets = max(64, total // (shards * BUCKET_ROWS))
    final = final.withColumn("bucket", F.pmod(F.xxhash64("id", "text_key"), F.lit(buckets)))
    from pyspark.sql import Window as W

    counts = final.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_key"))
    out = final.withColumn("rank", rank).join(before, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"))


def op1_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kd_shards(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
