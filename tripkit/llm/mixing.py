"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are the blocks that are dealt out. Every source has them in a permuted order; its
target fixes how many it gives, exactly. A binary tree over the output shards then splits
these quotas: each node draws, without replacement, which of its blocks go left. A leaf
holds exact quotas, taken as disjoint runs of the sources' permuted orders, and is shuffled
locally. All draws depend on seeds and hashes only, so a task that runs again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripkit.llm.common import broadcast_if_small, row_hash, word_count
from tripkit.operators.layout import checkpointed, with_position

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SHARDS = 16
SEED = 5
# About so many documents of a source are ordered in one group.
GROUP_ROWS = 4096
# Sources are hashed into so many chunks before their blocks are dealt out.
CHUNKS = 4096


def source_sizes(docs: DataFrame, source: str, size: str) -> DataFrame:
    """``(source, rows, source_size)`` of each source, NULL among them."""
    return docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(size).alias("source_size")
    )


def water_level(weighted: DataFrame, share: float, repeats: int) -> float:
    """Words per unit of weight at which capped targets add up to ``share`` of all sizes.

    ``weighted`` has ``weight`` and ``source_size``. Every turn is one aggregate: sources above
    their cap are set to it, and what is left is shared among the others, until none is above.
    The driver holds this one number.
    """
    total = share * float(weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    cap = F.lit(float(repeats)) * F.col("source_size")
    level, full = 0.0, -1
    while True:
        above = cap <= F.col("weight") * F.lit(level)
        row = weighted.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight").cast("double"))), F.lit(0.0)),
            F.count_if(above),
        ).first()
        if row[2] == full or not row[1]:
            return level if row[2] == full else math.inf
        level, full = (total - row[0]) / row[1], row[2]


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS
) -> DataFrame:
    """Add ``target`` (double): the words that each source gives to the mix.

    Sources in code-point order, NULL last, weigh ``weights`` over and over. Targets share
    ``share`` of all sizes; none exceeds ``repeats`` times its source's size, and what a source
    can't give is shared again by weight. Sources without words have target 0.
    """
    placed = with_position(sizes, F.col("source").asc_nulls_last(), out="place")
    number = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1)
    weighted = checkpointed(placed.withColumn("weight", weight))
    level = water_level(weighted, share, repeats)
    cap = F.lit(float(repeats)) * F.col("source_size")
    target = cap if math.isinf(level) else F.least(cap, F.col("weight") * F.lit(level))
    return weighted.select("source", "rows", "source_size", "weight", target.cast("double").alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``(shard, source, quota)``: deal every source's blocks out to ``shards`` shards.

    ``quotas`` has ``source`` (string, may be NULL) and ``quota`` (long). A node of the tree
    covers a range of shards; it draws how many blocks of each source go to its left half by a
    multivariate hypergeometric law, so that both halves get their share of blocks and all
    quotas are kept exactly.

    Sources are hashed into ``CHUNKS`` chunks. The tree deals out the chunks' quotas first; then
    each chunk's sources are dealt in a task of their own by the same tree, whose nodes draw as
    many blocks as the chunk gave there. That is the same law, and no task sees all sources.
    """
    chunked = quotas.select(
        F.pmod(F.xxhash64("source"), F.lit(CHUNKS)).cast("string").alias("chunk"), "source", F.col("quota").cast("long").alias("quota")
    )
    totals = chunked.groupBy("chunk").agg(F.sum("quota").alias("quota"))
    dealt = _split_chunks(totals.withColumnRenamed("chunk", "source"), shards, seed)

    def deal(sources: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", na_position="last", kind="stable")
        shares = shares.sort_values("shard")
        chunk = int(sources["chunk"].iloc[0])
        wanted = shares["quota"].to_numpy(np.int64)
        made = []
        todo = [(0, len(wanted), sources["quota"].to_numpy(np.int64))]
        while todo:
            low, high, colors = todo.pop()
            if high - low == 1:
                made.append(pd.DataFrame({"shard": low, "source": sources["source"].to_numpy(), "quota": colors}))
                continue
            middle = (low + high) // 2
            left = draw_colors(np.random.default_rng([seed, low, high, chunk + 1]), colors, int(wanted[low:middle].sum()))
            todo += [(low, middle, left), (middle, high, colors - left)]
        return pd.concat(made)

    return (
        chunked.groupBy("chunk")
        .cogroup(dealt.withColumnRenamed("source", "chunk").groupBy("chunk"))
        .applyInPandas(deal, "shard int, source string, quota long")
    )


def draw_colors(rng: np.random.Generator, colors: np.ndarray, draws: int) -> np.ndarray:
    """How many of each color are among ``draws`` drawn without putting back."""
    left, rest = np.zeros(len(colors), np.int64), int(colors.sum())
    for i, color in enumerate(colors.tolist()):
        rest -= color
        left[i] = draw_hypergeometric(rng, color, rest, draws)
        draws -= int(left[i])
    return left


def _split_chunks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """The tree over at most ``CHUNKS`` rows: a level is one grouped job over (node, chunk) rows."""
    if shards < 1:
        raise ValueError("at least one shard")
    schema = "low int, high int, source string, quota long"

    def halve(node: pd.DataFrame) -> pd.DataFrame:
        low, high = int(node["low"].iloc[0]), int(node["high"].iloc[0])
        if high - low == 1:
            return node[["low", "high", "source", "quota"]]
        node = node.sort_values("source", na_position="last", kind="stable")
        colors, middle = node["quota"].to_numpy(np.int64), (low + high) // 2
        draws = int(colors.sum()) * (middle - low) // (high - low)
        left = draw_colors(np.random.default_rng([seed, low, high]), colors, draws)
        halves = [
            pd.DataFrame({"low": a, "high": b, "source": node["source"], "quota": n})
            for a, b, n in ((low, middle, left), (middle, high, colors - left))
        ]
        return pd.concat(halves)

    nodes = quotas.select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), "source", F.col("quota").cast("long").alias("quota")
    )
    for _ in range(math.ceil(math.log2(shards))):
        nodes = nodes.groupBy("low", "high").applyInPandas(halve, schema)
    return nodes.select(F.col("low").alias("shard"), "source", "quota")


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good, by the hypergeometric law at any size.

    Numbers that the generator's own method doesn't take are drawn by the ratio of uniforms: a
    candidate near the middle is accepted with its exact probability, up to the rounding of
    log-factorials.
    """
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)

    def log_weight(k: int) -> float:
        return -sum(math.lgamma(n + 1) for n in (k, good - k, draws - k, bad - draws + k))

    share = good / total
    spread = math.sqrt(draws * share * (1 - share) * (total - draws) / max(total - 1, 1) + 0.5)
    # The region that is drawn from holds the law's: its sides are those for any unimodal law of this spread.
    width, top = math.sqrt(8 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e), log_weight(mode)
    while True:
        height = 1.0 - rng.random()
        k = math.floor(draws * share + 0.5 + width * (rng.random() - 0.5) / height)
        if low <= k <= high and 2 * math.log(height) <= log_weight(k) - top:
            return k


def _grouped(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Add its source's figures to each row, and the group of the source's order it lies in.

    The order is that of ``draw``, a row hash. A source's rows go to groups of about
    ``GROUP_ROWS`` by it, so that only a group is ever sorted in one task.
    """
    counted = targets.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.greatest(F.ceil(F.col("rows") / GROUP_ROWS), F.lit(1)).cast("long").alias("groups"),
    )
    return (
        rows.join(broadcast_if_small(counted), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("part", F.pmod(F.shiftright("draw", 20), F.col("groups")))
        .drop("source", "groups")
    )


def _offsets(grouped: DataFrame) -> DataFrame:
    """Rows and words of a source before each of its groups: one row per group."""
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("of", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    return checkpointed(
        groups.select(
            F.col("of").alias("off_of"),
            F.col("part").alias("off_part"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"),
        )
    )


def _placed(grouped: DataFrame, offsets: DataFrame, repeats: int, whole: bool) -> DataFrame:
    """Add ``place``, a row's number in its source's order, and ``words``, what each epoch takes.

    The target ends inside one row of the source. Its words up to there are taken, or if ``whole``
    all of its words or none, whichever is nearer.

    Rows that are alike in all columns may swap places, which changes nothing.
    """
    here = Window.partitionBy("of", "part").orderBy("draw")
    inside = here.rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("words_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = (
        grouped.join(
            broadcast_if_small(offsets), F.col("of").eqNullSafe(F.col("off_of")) & (F.col("part") == F.col("off_part"))
        )
        .withColumn("place", F.col("n_before") + F.row_number().over(here) - 1)
        .withColumn("before", at)
    )

    def taken(epoch: int) -> Column:
        left = F.round("target").cast("long") - F.col("before") - F.lit(epoch) * F.col("source_size")
        if whole:
            return F.when((left > 0) & (2 * left >= F.col("size")), F.col("size")).otherwise(0)
        return F.greatest(F.least(left, F.col("size")), F.lit(0))

    return placed.withColumn("words", F.array(*[taken(e) for e in range(repeats)])).drop(
        "off_of", "off_part", "n_before", "words_before", "before", "part"
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = MAX_REPEATS,
    shards: int = SHARDS,
    seed: int = SEED,
    carry: Sequence[str] | None = None,
    whole: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its columns in ``row``, and what the mix takes of it.

    ``carry`` names the columns that ``row`` has (default: all); the others don't travel.

    ``size`` words of the text (NULL: 0), ``source_size``, ``target`` and ``draws``, an array of
    ``(epoch, words, shard, shuffle_key)`` with an entry for each time the row is drawn, at most
    ``repeats``. A source gives its rows in permuted order, over again where its target exceeds
    its size, and the last one only as far as the target reaches (rounded to a word), so the
    words of a source's draws add up to its target. With ``whole`` that last row is drawn whole or
    not at all, whichever comes nearer to the target. Rows without words are never drawn.
    A NULL source is a source; no rows give no rows. Rows count as they are, repeated or not.
    """
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in (carry or docs.columns)]).alias("row"),
        docs[f"`{source}`"].cast("string").alias("source"),
        word_count(docs[f"`{text}`"].cast("string")).alias("size"),
        row_hash(docs, F.lit(seed)).alias("draw"),
    )
    # Without the texts, for the passes that only count.
    slim = checkpointed(packed.select("source", "size", "draw"))
    targets = checkpointed(source_targets(source_sizes(slim, "source", "size"), weights, share, repeats))
    offsets = _offsets(_grouped(slim, targets))
    # A source's number of blocks in each epoch; its order over all epochs is place after place.
    counts = [
        F.coalesce(F.max(F.when(F.col("words")[e] > 0, F.col("place") + 1)), F.lit(0)).cast("long")
        for e in range(repeats)
    ]
    quotas = checkpointed(
        _placed(_grouped(slim, targets), offsets, repeats, whole)
        .groupBy("of")
        .agg(F.array(*counts).alias("blocks"))
        .select(F.col("of").alias("source"), "blocks")
    )
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b)
    leaves = split_quotas(quotas.select("source", total.alias("quota")), shards, seed)
    # Where each shard's run ends in the order of a source, shard after shard.
    ends = Window.partitionBy("source").orderBy("shard")
    runs = (
        leaves.withColumn("until", F.sum("quota").over(ends))
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("shard", "until"))).alias("runs"))
    )
    plan = checkpointed(
        quotas.withColumnRenamed("source", "p_of")
        .join(runs, F.col("p_of").eqNullSafe(F.col("source")))
        .select("p_of", "blocks", F.transform("runs", lambda r: r["until"]).alias("until"))
    )
    drawn = _placed(_grouped(packed, targets), offsets, repeats, whole)
    joined = drawn.join(broadcast_if_small(plan), F.col("of").eqNullSafe(F.col("p_of")))

    def draw(epoch: int) -> Column:
        at = sum((F.col("blocks")[e] for e in range(epoch)), F.col("place"))
        shard = F.size(F.filter("until", lambda end: end <= at))
        return F.struct(
            F.lit(epoch).alias("epoch"),
            F.col("words")[epoch].alias("words"),
            shard.alias("shard"),
            F.xxhash64("draw", F.lit(seed), F.lit(epoch)).alias("shuffle_key"),
        )

    draws = F.filter(F.array(*[draw(e) for e in range(repeats)]), lambda d: d["words"] > 0)
    return joined.select("row", "size", "source_size", "target", draws.alias("draws"))


def taken_words(draws: str = "draws") -> Column:
    """Words that a row's draws add up to."""
    return F.aggregate(draws, F.lit(0).cast("long"), lambda total, d: total + d["words"])


def write_order(mixed: DataFrame) -> DataFrame:
    """The draws one per row, shard after shard and shuffled within: ``(row, size, draw)``.

    Range-sorted, so a shard larger than a partition takes several neighbouring ones.
    """
    exploded = mixed.select("row", "size", F.explode("draws").alias("draw"))
    return exploded.orderBy("draw.shard", "draw.shuffle_key")


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each draw, in shuffled order.

    Every document is drawn whole, so a source's words miss its target by half a document at most.
    """
    rows = write_order(mix(docs, source, text, whole=True, **how))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
