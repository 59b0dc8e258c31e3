"""Document fingerprints by SpotSigs: chains of content words behind common words.

Wherever a common word (an anchor) stands, the next few content words form a signature. The
set of a text's signatures is its fingerprint. Sets are compared by Jaccard similarity, which
can reach a threshold only between sets of similar sizes: partitions by set length and an
index of each set's rarest signatures leave few pairs to compare.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripkit.llm.common import append_columns, broadcast_if_small
from tripkit.llm.simhash import CELLS, rarest_shingles
from tripkit.operators.layout import checkpointed, with_position

CHAIN = 2
RANGE_BYTES = 256 << 20
# Common words that are anchors, and further ones that only chains skip.
ANCHORS = frozenset(
    "a an the is are was were be to of in and that with for on from by it this or as at "
    "le la les un une des de du et est dans pour que qui sur par avec il elle en au pas "
    "der die das ein eine und ist von zu mit auf für im den dem nicht sich als auch es "
    "el los las una y es en que se por con para del al lo su no".split()
)
SKIPPED = frozenset("i you he she we they not have has had will would can do does did but if so their its".split())
_WORDS = re.compile(r"\w+").findall


def signatures(text: str | None, chain: int = CHAIN, anchors: frozenset[str] = ANCHORS) -> np.ndarray:
    """The sorted distinct 64-bit signatures of a text.

    A chain needs at least one content word; at the end of a text it is as long as what is
    left. A text without chains has one signature, that of its words (of its characters, if it
    has no words); NULL and empty texts share one.
    """
    words = _WORDS((text or "").lower())
    content: list[str] = []
    starts: list[int] = []
    for word in words:
        if word in anchors:
            starts.append(len(content))
        elif word not in SKIPPED:
            content.append(word)
    digest = xxhash.xxh64_intdigest
    chains = {" ".join(content[at : at + chain]) for at in set(starts) if at < len(content)}
    if not chains:
        return np.array([digest(("\n" + (" ".join(words) or (text or ""))).encode("utf-8", "surrogatepass"))], np.uint64)
    return np.sort(np.fromiter((digest(c.encode("utf-8", "surrogatepass")) for c in chains), np.uint64, len(chains)))


def fingerprint_text(found: np.ndarray) -> str:
    """Length of the set, and a 128-bit digest of it: equal sets, equal fingerprints."""
    return f"{len(found):x}-{xxhash.xxh128_hexdigest(found.astype('<u8').tobytes())}"


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where their lengths rule out ``least``."""
    few, many = sorted((len(a), len(b)))
    if many == 0:
        return 1.0
    if few < (least - 1e-9) * many:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (few + many - both)


def with_spotsigs(docs: DataFrame, text: str = "text", out: str = "signatures", chain: int = CHAIN) -> DataFrame:
    """All columns of ``docs`` plus the sorted signatures of the whole text, packed as little-endian longs."""

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([signatures(t, chain).astype("<u8").tobytes() for t in arrays[0].to_pylist()], pa.binary())]

    return append_columns(docs, [text], {out: "binary"}, work)


def _cuts(rows: DataFrame, low: Column, range_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first key ``(low, tie)`` of each of about ``range_count`` ranges of equally many rows, in order."""
    placed = with_position(rows.select(low.alias("low"), F.xxhash64("text").alias("tie")), F.col("low"), F.col("tie"), out="at")
    step = max(1, -(-placed.count() // range_count))
    heads = placed.where(F.col("at") % step == 0).select("low", "tie").distinct().toArrow().sort_by([("low", "ascending"), ("tie", "ascending")])
    return heads["low"].to_numpy(), heads["tie"].to_numpy()


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(doc_id, text, next_text)``: each text (NULL: empty) beside that of the next id, after the last the first.

    Rows that repeat an id follow one another in the order of their texts' hashes; NULL ids come
    first. A narrow pass sorts ids and hashes and cuts them into ranges of equally many rows, so
    that rows of one id, or without one, are split too; only rows alike in both stay together.
    The cuts, one for about ``range_bytes`` of text, are looked up by bisection. The first row
    of a range is sent to the range before it as well: every text is shuffled about once and no
    range needs another. A single row is its own next; an empty table has no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    low = F.coalesce("doc_id", F.lit(-(1 << 63)))
    session = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * range_bytes)))
    cuts = _cuts(rows, low, max(4 * parts, -(-total // range_bytes)))
    if not len(cuts[0]):
        return rows.withColumn("next_text", F.lit(""))
    sent = session.sparkContext.broadcast(cuts)

    def ranges(lows: pd.Series, ties: pd.Series) -> pd.Series:
        """The range of each key and, where it is the first of its range, the range before."""
        first, tie = sent.value
        keys, own = lows.to_numpy(), ties.to_numpy()
        start, end = np.searchsorted(first, keys, "left"), np.searchsorted(first, keys, "right")
        found = []
        for s, e, t in zip(start.tolist(), end.tolist(), own.tolist(), strict=True):
            at = s + int(np.searchsorted(tie[s:e], t, "right")) - 1 if e > s else e - 1
            head = at >= s and tie[at] == t
            found.append([at, (at - 1) % len(first)] if head else [at])
        return pd.Series(found)

    to = F.pandas_udf(ranges, "array<int>")(F.col("low"), F.col("tie"))
    keyed = rows.select("doc_id", "text", low.alias("low"), F.xxhash64("text").alias("tie"))
    dealt = keyed.withColumn("to", to).select("doc_id", "text", "low", "tie", F.posexplode("to").alias("copy", "range"))
    order = Window.partitionBy("range").orderBy("copy", "low", "tie")
    moved = dealt.repartition(parts, "range").withColumn("next_text", F.lead("text").over(order))
    return moved.where("copy = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def near_pairs(docs: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """``(a, b, likeness)``: pairs of distinct fingerprints, by their smallest ids, at ``threshold`` or above.

    Equal fingerprints are one class, named by its smallest id, and are not paired; a class whose
    ids are all NULL has no name and no pairs. Sets are
    dealt to partitions of similar length (neighbouring lengths whose ratio stays within
    the threshold); a set looks into its own and the next one. Inside, two sets can reach the
    threshold only if they share one of their first signatures in the order of rarity, as many
    as ``len - ceil(threshold * len) + 1``; those are the keys of an equality join. A pair goes on
    only if the ratio of lengths and what both sets have left from their first common signature
    on can still reach the threshold; then the sets themselves are compared. Rarity is counted in
    2**18 cells over all sets. A key of more than ``block`` sets is joined in blocks of its left
    side, each a key of its own, so no task gets all of it.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    marked = with_spotsigs(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), "text", "sigs")
    sets = checkpointed(marked.groupBy("sigs").agg(F.min("id").alias("id")).where("id is not null"))

    def cells(arrays: list[pa.Array]) -> list[pa.Array]:
        own = [(np.frombuffer(s, "<u8") & np.uint64(CELLS - 1)).astype("<i4") for s in arrays[0].to_pylist()]
        return [pa.array(own, pa.list_(pa.int32()))]

    counted = append_columns(sets, ["sigs"], {"cells": "array<int>"}, cells, keep=[])
    loads = np.zeros(CELLS, np.int64)
    for row in checkpointed(counted.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))).collect():
        loads[row["cell"]] = row["n"]  # at most CELLS rows
    sent = sets.sparkSession.sparkContext.broadcast(loads)

    def rarest(arrays: list[pa.Array]) -> list[pa.Array]:
        found = [rarest_shingles(np.frombuffer(s, "<u8"), sent.value, threshold) for s in arrays[0].to_pylist()]
        return [pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))]

    size = (F.length("sigs") / 8).cast("int")
    # At 1 only sets of one length can be equal, and the length is the partition. Below, a
    # partition is a hair wider than the threshold asks, so that rounding separates no pair.
    part = F.floor(F.log("size") / F.lit(-math.log(threshold * (1 - 1e-9)))) if threshold < 1 else F.col("size").cast("long")
    ranked = append_columns(sets.select("id", size.alias("size"), "sigs"), ["sigs"], {"rare": "array<long>"}, rarest, keep=["id", "size"])
    keys = checkpointed(ranked.select("id", "size", part.alias("part"), F.posexplode("rare").alias("at", "sig")))
    # The left side is split only as far as its own rows under the key ask for.
    hot = checkpointed(keys.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1"))
    keys = keys.join(broadcast_if_small(hot), "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = keys.select(
        F.col("id").alias("x"), F.col("size").alias("x_size"), F.col("at").alias("x_at"), "sig",
        F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.array("part", F.col("part") + 1)).alias("part"),
    )
    right = keys.select(
        F.col("id").alias("y"), F.col("size").alias("y_size"), F.col("at").alias("y_at"), "sig", "part",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"),
    )
    least = F.lit(threshold - 1e-9)
    in_reach = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    pairs = (
        left.join(right, ["part", "sig", "block"])
        .where((F.col("x") != F.col("y")) & (F.least("x_size", "y_size") >= least * F.greatest("x_size", "y_size")))
        .where(in_reach >= least * (F.col("x_size") + F.col("y_size") - in_reach))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("a_sigs")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("sigs").alias("b_sigs")), "b"
    )
    return with_likeness(full, [("a_sigs", "b_sigs", "likeness")], threshold).where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def with_likeness(rows: DataFrame, pairs: Sequence[tuple[str, str, str]], least: float = 0.0) -> DataFrame:
    """Add the Jaccard similarity of packed signature columns: ``(first, second, name)`` for each."""

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        sets = [[np.frombuffer(s, "<u8") for s in array.to_pylist()] for array in arrays]
        return [
            pa.array([jaccard(a, b, least) for a, b in zip(sets[2 * i], sets[2 * i + 1], strict=True)], pa.float64())
            for i in range(len(pairs))
        ]

    inputs = [name for first, second, _ in pairs for name in (first, second)]
    return append_columns(rows, inputs, {name: "double" for _, _, name in pairs}, work, at_once=1024)


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and of the next one, and their likeness.

    ``(doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next)``. Every
    likeness is exact: nothing is pruned, because no threshold is asked for.
    """
    rows = with_next(docs, doc_id, text).select("doc_id", "text", "next_text", edited(F.col("text"), F.col("next_text")).alias("edited"))

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        texts, following, changed = (a.to_pylist() for a in arrays)
        own, other, near, beside = [], [], [], []
        known, known_text = None, None
        for t, n, e in zip(texts, following, changed, strict=True):
            # Rows come in order, so a text is mostly the one that was next before.
            mine = known if t == known_text else signatures(t)
            known_text, known = n, signatures(n)
            theirs = signatures(e)
            own.append(fingerprint_text(mine))
            other.append(fingerprint_text(theirs))
            near.append(jaccard(mine, theirs))
            beside.append(jaccard(mine, known))
        return [pa.array(own), pa.array(other), pa.array(near, pa.float64()), pa.array(beside, pa.float64())]

    made = {"fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    return append_columns(rows, ["text", "next_text", "edited"], made, work, at_once=512, keep=["doc_id", "text", "edited"])
