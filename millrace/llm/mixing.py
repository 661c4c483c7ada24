"""Mixing sources to target weights by temperature (operator 9).

Source shares of the tokens are raised to an exponent between 0 and 1 and normalised. The exponent is the flattest
that keeps every source within `max_repeats` passes over its documents, or the steepest that still reaches a target
entropy; it is found by bisection into `GRID` parts a round, each round one aggregate over the table of sources. The
budget is the smallest at which no source loses a document, or a given number of tokens.

A source that owes e passes gets floor(e) whole ones and a last one that stops within its budget of tokens: documents
are dealt to blocks of about `BLOCK` by hash, blocks are permuted anew in each pass, and the documents in them too. The
place where the last pass stops is found by narrowing histograms of the permutation's key, all sources at once.

Defined results: a null source is a source of its own; documents without words have no tokens and their sources, if
they hold nothing else, get one pass; repeated rows are dealt alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, word_array

MAX_REPEATS = 2.0
GRID = 64
ROUNDS = 5
BINS = 1024
BLOCK = 256
SEED = 9
#: Sources up to which their table is broadcast: some 100 bytes each.
BROADCAST_SOURCES = 100_000
_ROW_KEY = "_row_key"


def _evaluated(stats: DataFrame, low: float, high: float) -> list:
    """Entropy and the largest ratio of passes at each exponent of the grid."""
    alphas = F.array(*[F.lit(low + (high - low) * i / GRID) for i in range(GRID + 1)])
    rows = stats.where("tokens > 0").select("tokens", F.log("share").alias("l"), F.posexplode(alphas).alias("i", "a"))
    scaled = F.exp(F.col("a") * F.col("l"))
    got = rows.groupBy("i", "a").agg(F.sum(scaled).alias("z"), F.sum(scaled * F.col("l")).alias("zl"), F.max(F.log(scaled) - F.log("tokens")).alias("most"), F.min(F.log(scaled) - F.log("tokens")).alias("least"))
    return got.select("i", "a", (F.log("z") - F.col("a") * F.col("zl") / F.col("z")).alias("entropy"), F.exp(F.col("most") - F.col("least")).alias("repeats")).orderBy("i").collect()  # GRID + 1 rows


def _bisected(stats: DataFrame, fits, rising: bool) -> float:
    """The smallest exponent that fits if all above it do (rising), else the largest if all below it do."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        got = _evaluated(stats, low, high)
        ok = [i for i, r in enumerate(got) if fits(r)]
        if not ok:
            return high if rising else low
        i = min(ok) if rising else max(ok)
        if rising and i == 0 or not rising and i == len(got) - 1:
            return got[i]["a"]
        low, high = (got[i - 1]["a"], got[i]["a"]) if rising else (got[i]["a"], got[i + 1]["a"])
    return high if rising else low


def exponent(stats: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent for (tokens, share): the steepest that reaches the entropy, if one is asked for, else the flattest; but never beyond the repeats."""
    reach = 0.0 if entropy is None else _bisected(stats, lambda r: r["entropy"] >= entropy, rising=False)
    if max_repeats is None:
        return reach if entropy is not None else 1.0
    return max(reach, _bisected(stats, lambda r: r["repeats"] <= max_repeats * (1 + 1e-12), rising=True))


def _source(c: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _row_key(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def block_of(row_key: F.Column, blocks: F.Column) -> F.Column:
    return F.pmod(row_key, blocks)


def order_key(row_key: F.Column, block: F.Column, epoch: F.Column) -> F.Column:
    """Place in one pass: blocks by a hash of the pass, then documents by another. 63 bits."""
    high = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), epoch.cast("long"), block), 33)
    low = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), epoch.cast("long"), row_key), 32)
    return F.shiftleft(high, 32).bitwiseOR(low)


def _small(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def _stops(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """(src, stop): keys below stop are in the last pass of their source."""
    state = sources.select("src", "blocks", "whole", (F.col("passes") - F.col("whole")).alias("part"), "tokens").withColumns({"want": F.col("part") * F.col("tokens"), "low": F.lit(0).cast("long"), "high": F.lit((1 << 63) - 1), "below": F.lit(0).cast("long")})
    keyed = cut(rows.join(_small(sources.select("src", "blocks", "whole"), n), "src").withColumn("block", block_of(F.col(_ROW_KEY), F.col("blocks"))).select("src", F.col("n_tokens"), order_key(F.col(_ROW_KEY), F.col("block"), F.col("whole")).alias("key")))
    state = cut(state.select("src", "want", "low", "high", "below"))
    for _ in range(8):
        inside = keyed.join(_small(state.where("low < high"), n), "src").where("key between low and high")
        bins = inside.groupBy("src", "want", "below", F.expr(f"(key - low) div ((high - low) div {BINS}L + 1L)").alias("bin")).agg(F.sum("n_tokens").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"))
        upto = F.sum("w").over(W.partitionBy("src").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))  # at most BINS rows a source
        hit = bins.withColumn("upto", F.col("below") + upto).where("upto > want").groupBy("src").agg(F.min(F.struct("bin", (F.col("upto") - F.col("w")).alias("below"), "least", "most")).alias("m"))
        moved = state.where("low < high").select("src", "want").join(hit, "src", "left").select("src", "want", F.coalesce("m.least", F.lit((1 << 63) - 1)).alias("low"), F.coalesce("m.most", F.lit((1 << 63) - 1)).alias("high"), F.coalesce("m.below", F.lit(0).cast("long")).alias("below"))
        state = cut(state.where("low >= high").unionByName(moved))
        if state.where("low < high").isEmpty():
            break
    return state.select("src", F.col("low").alias("stop"))


def mixture(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, src, n_tokens, row key), the sources with weight, passes, whole passes and stop, and how many sources there are."""
    rows = cut(df.select(F.col(id_col).alias("id"), _source(source_col).alias("src"), F.size(word_array(F.col(text_col))).cast("long").alias("n_tokens"), _row_key(id_col, text_col).alias(_ROW_KEY)))
    stats = cut(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    n, total = stats.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    stats = stats.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    a = exponent(stats, max_repeats, entropy)
    raised = stats.withColumn("raised", F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    z, need = raised.agg(F.sum("raised"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raised")))).first()
    spend = float(budget) if budget is not None else (need or 0.0) * (z or 0.0)
    weighted = raised.withColumn("weight", F.col("raised") / F.lit(float(z or 1)))
    # Passes are rounded far below a token's share, so that a source that owes one pass owes exactly one.
    passes = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(spend) / F.col("tokens"), 9)).otherwise(1.0)
    sources = weighted.withColumn("passes", passes).withColumn("whole", F.floor("passes").cast("int")).withColumn("blocks", F.ceil(F.col("docs") / F.lit(BLOCK)).cast("long"))
    sources = cut(sources.select("src", "tokens", "docs", "share", "weight", "passes", "whole", "blocks"))
    sources = cut(sources.join(_stops(rows, sources, n), "src"))
    return rows, sources, n


def epochs(row_key: F.Column) -> F.Column:
    """The passes that a row is in; the row must hold its source's columns."""
    last = order_key(row_key, block_of(row_key, F.col("blocks")), F.col("whole")) < F.col("stop")
    n = F.col("whole") + F.when(last & (F.col("passes") > F.col("whole")), 1).otherwise(0)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """(id, source, epoch, block, slot, order_key, n_tokens, weight): a row for each document drawn; a pass is read by order_key."""
    rows, sources, n = mixture(df, id_col, source_col, text_col, **options)
    drawn = rows.join(_small(sources, n), "src").withColumn("epoch", F.explode(epochs(F.col(_ROW_KEY)))).withColumn("block", block_of(F.col(_ROW_KEY), F.col("blocks")))
    drawn = drawn.withColumn("order_key", order_key(F.col(_ROW_KEY), F.col("block"), F.col("epoch")))
    slot = F.row_number().over(W.partitionBy("src", "epoch", "block").orderBy("order_key", "id")) - 1  # a block holds about BLOCK rows
    name = F.when(F.col("src") != "", F.expr("substring(src, 2)"))
    return drawn.withColumn("slot", slot).select(F.col("id").alias(id_col), name.alias(source_col), "epoch", "block", "slot", "order_key", "n_tokens", "weight")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """df with each row as often as it is drawn."""
    _, sources, n = mixture(df, id_col, source_col, text_col, **options)
    packed = df.select(F.struct("*").alias("row"), _source(source_col).alias("src"), _row_key(id_col, text_col).alias(_ROW_KEY))
    found = packed.join(_small(sources.select("src", "passes", "whole", "blocks", "stop"), n), "src")
    return found.select("row", F.explode(epochs(F.col(_ROW_KEY)))).select("row.*")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
