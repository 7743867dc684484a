"""Mixing sources to target weights, in DataFrame functions only.

A source's share of tokens is raised to an exponent between 1 (as it is) and 0 (all alike) and normalised. The exponent
is bisected to the largest one that reaches a target entropy, but not below the least one that keeps every source within
a repetition limit. Weights times the budget are tokens to draw from each source. They are drawn as block permutations:
a source's documents are hashed into blocks, each pass through the source takes its blocks in another order, whole passes
take all blocks, and the last one takes blocks until the budget is reached. The budget is met to within one block of a
source. ``position`` (0 to 1) interleaves the sources evenly.

Windows run over blocks and never over documents: blocks number at most MOST_BLOCKS plus LEAST_BLOCKS a source, so a
source with a third of all rows is a third of that. Texts are not shuffled.

Defined cases: a null source is a source of its own. A null text has no tokens; a source without tokens gets no weight
and no rows, unless each document is to be drawn once at least (no budget), which then holds for all rows. A single source has weight 1. Repeated rows are drawn together. A null doc_id is drawn like any other. An
empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty

BLOCK_TOKENS = 1 << 16
MOST_BLOCKS = 100_000
LEAST_BLOCKS = 64
#: Sources' rows are broadcast up to this number of them (about 60 bytes each).
BROADCAST_SOURCES = 100_000
BROADCAST_BLOCKS = 400_000
STEPS = 60


def n_tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def _uniform(*parts) -> Column:
    """A whole number below 2^32 drawn from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def source_weights(sizes: DataFrame, *, entropy_share: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """sizes: (source, tokens). Returns source, tokens, exponent, weight, quota (tokens to draw).

    entropy_share: target entropy as a share of the entropy of equal weights. budget: tokens to draw in all; without it,
    the least that shows each document once, and repeats are counted from there."""
    alone = sizes.where("tokens > 0").agg(F.collect_list(F.col("tokens").cast("double")).alias("t")).selectExpr("t", "aggregate(t, 0D, (a, x) -> a + x) AS total").selectExpr("transform(t, x -> x / total) AS p", "total")
    z = "aggregate(p, 0D, (a, x) -> a + pow(x, {m}))"
    entropy = f"(ln({z}) - {{m}} * aggregate(p, 0D, (a, x) -> a + pow(x, {{m}}) * ln(x)) / {z})"
    if budget is None:
        repeats = "pow(array_max(p) / array_min(p), 1 - {m})"
    else:
        repeats = f"(pow(array_min(p), {{m}} - 1) * {float(budget)}D / total / {z})"
    flat_enough = f"{entropy} >= {float(entropy_share)}D * ln(size(p)) - 1e-12D" if entropy_share is not None else "true"
    too_often = f"{repeats} > {float(max_repeats)}D" if max_repeats is not None else "false"

    def bisect(up: str) -> str:
        """The border between exponents for which ``up`` holds (below it) and those above."""
        step = f"if({up.format(m='(s.lo + s.hi) / 2')}, named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2))"
        return f"if({up.format(m='1D')}, 1D, if(NOT ({up.format(m='0D')}), 0D, aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, k) -> {step}, s -> (s.lo + s.hi) / 2)))"

    found = alone.selectExpr("p", "total", f"greatest({bisect(flat_enough)}, {bisect(too_often) if max_repeats is not None else '0D'}) AS exponent")
    found = found.selectExpr("exponent", "total", f"{z.format(m='exponent')} AS z", "array_max(transform(p, x -> pow(x, 1 - exponent))) AS most")
    out = sizes.crossJoin(F.broadcast(found))  # one row
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).otherwise(0.0)
    # every document once: weight * budget >= tokens for each source
    whole = F.lit(float(budget)) if budget is not None else F.col("most") * F.col("z") * F.col("total")
    quota = F.floor(weight * whole + 1e-6)
    return out.select("source", "tokens", "exponent", weight.alias("weight"), quota.cast("bigint").alias("quota"))


def _key() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def _sizes(tokens: str | None) -> Column:
    return n_tokens_of(text_or_empty()) if tokens is None else F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")


def plan(docs: DataFrame, *, tokens: str | None = None, seed: int = 17, entropy_share: float | None = 0.98, max_repeats: float | None = 4.0, budget_share: float | None = 1.0) -> tuple[DataFrame, DataFrame]:
    """(weights by source, drawn blocks). budget_share: budget in tokens of the corpus; None: each document once at least.
    tokens: the column of docs with each document's tokens (as a counting operator gives them); without it, its words count."""
    rows = docs.select(_key().alias("source"), F.col("doc_id").cast("string").alias("id"), _sizes(tokens).alias("tokens"))
    sizes = stored(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    weights = source_weights(sizes, entropy_share=entropy_share, max_repeats=max_repeats, budget=None if budget_share is None else int(total * budget_share))
    size = max(BLOCK_TOKENS, total // MOST_BLOCKS)
    weights = stored(weights.withColumn("n_blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / size)).cast("bigint")).withColumn("block_seed", F.lit(seed)), "weights")
    blocks = _in_blocks(rows, weights).groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    each_once = budget_share is None
    whole = F.when(F.col("tokens") > 0, F.floor(F.coalesce("quota", F.lit(0)) / F.col("tokens"))).otherwise(0).cast("bigint")
    passes = blocks.join(weights if each_once else weights.where("tokens > 0 and quota > 0"), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)))
    passes = passes.withColumn("turn", _uniform(F.col("block_seed"), F.col("epoch"), F.col("source"), F.col("block")))
    order = Window.partitionBy("source", "epoch").orderBy("turn", "block")
    passes = passes.withColumn("before", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens"))
    left = F.col("quota") - F.col("epoch") * F.col("tokens")
    due = (F.col("before") < left) & (left > 0)
    place = F.when(F.col("quota") > 0, (F.col("epoch") * F.col("tokens") + F.col("before")) / F.col("quota")).otherwise(0.0)
    drawn = passes.where(due | (F.col("epoch") == 0) if each_once else due).withColumn("position", place)
    return weights, stored(drawn.select("source", "block", "epoch", "position", "block_tokens"), "blocks")


def _in_blocks(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows: (source, id, ...), to which the block is added."""
    known = weights.select("source", "n_blocks", "block_seed")
    if known.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    joined = rows.join(known, "source")
    return joined.withColumn("block", F.pmod(_uniform(F.col("block_seed"), F.lit("doc"), F.coalesce("id", F.lit("null"))), F.col("n_blocks"))).drop("n_blocks", "block_seed")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, epoch, block, position, n_tokens, weight: a row for each time that a document is drawn."""
    weights, drawn = plan(docs, **options)
    rows = docs.select(_key().alias("source"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("name"), _sizes(options.get("tokens")).alias("n_tokens"))
    rows = _in_blocks(rows, weights)
    drawn = drawn.join(weights.select("source", "weight"), "source")
    if drawn.count() <= BROADCAST_BLOCKS:
        drawn = F.broadcast(drawn)
    return rows.join(drawn, ["source", "block"]).select("doc_id", F.col("name").alias("source"), "epoch", "block", "position", "n_tokens", "weight")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as drawn, with docs' columns alone; a document that is drawn twice is there twice."""
    weights, drawn = plan(docs, **options)
    rows = _in_blocks(docs.select(F.struct(*docs.columns).alias("row"), _key().alias("source"), F.col("doc_id").cast("string").alias("id")), weights)
    drawn = drawn.select("source", "block", "epoch")
    if drawn.count() <= BROADCAST_BLOCKS:
        drawn = F.broadcast(drawn)
    return rows.join(drawn, ["source", "block"]).select("row.*")


def entropy(weights: list[float]) -> float:
    """Entropy of a list of weights, in nats (for reports and tests)."""
    return -sum(w * log(w) for w in weights if w > 0)
