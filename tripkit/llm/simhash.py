"""SimHash near-duplicates found through deletion variants of two segments.

A fingerprint of 64 bits is cut into two segments of 32 bits. Two fingerprints that differ in
at most two bits have a segment that differs in at most one bit. So each fingerprint is
indexed under its variants with one bit of the upper segment wiped out, and under both whole
segments. What is left of the two allowed bits must lie in the other segment, and one of its
halves (or thirds, where both may lie there) has none of them; that part joins the key. A
key thus holds at least 42 of the 64 bits, and equality joins on it find every link.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripkit.llm.common import append_columns, free_name
from tripkit.llm.components import components
from tripkit.llm.pivots import local_roots
from tripkit.operators.layout import checkpointed, ensure_checkpoint_dir
from tripkit.sources import read_trips

SHINGLE_WORDS = 5
SIMILARITY = 0.8
MAX_BITS = 2
SEED = 42
# Texts of at most so many distinct shingles are found by their rarest ones.
SHORT = 128
# Shingles are counted in so many cells, which bounds what the driver and the tasks hold.
CELLS = 1 << 18
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
_CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def run_hashes(found: list[bytes], words: int, seed: int = SEED) -> np.ndarray:
    """Hashes of every run of ``words`` words, repeats included; fewer words are one run, none no run."""
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    reach = min(words, len(found))
    spans = zip(starts[: len(found) - reach + 1].tolist(), ends[reach - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(found) - reach + 1)


def majority_bits(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each group of hashes (``heads`` are its first places) the bits that more than half of it have."""
    ones = np.zeros((len(heads), 64), np.int64)
    group = np.searchsorted(heads, np.arange(len(hashes)), "right") - 1
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        here = group[at : at + _CHUNK]
        cuts = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        ones[here[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    sizes = np.diff(np.append(heads, len(hashes)))
    return np.packbits(ones * 2 > sizes[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprint_of(text: str | None, words: int, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text as an unsigned integer: see ``with_fingerprint``."""
    return print_of_runs(run_hashes(words_of(text), words, seed))


def print_of_runs(hashes: np.ndarray) -> int:
    """The SimHash of a text's hashed runs."""
    return int(majority_bits(hashes, np.zeros(1, np.int64))[0]) if len(hashes) else 0


def with_fingerprint(
    docs: DataFrame,
    text: str = "text",
    words: int = SHINGLE_WORDS,
    out: str = "fingerprint",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) plus the fingerprint as a signed long.

    A-Z are lower-cased, words are runs without ASCII white space, and every run of ``words``
    words counts, repeats included; a shorter text counts as one run. A bit is set where more
    than half of the runs' hashes (XXH64, seed 42) have it. NULL, empty and blank texts have
    fingerprint zero. Rows are independent: repeated rows stay, in any order.
    """

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        made = [fingerprint_of(t, words) for t in columns[0].to_pylist()]
        return [pa.array(np.array(made, np.uint64).view(np.int64))]

    return append_columns(docs, [text], {out: "long"}, work, keep=keep)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks() -> list[int]:
    """The bits that each kind of key keeps: three kinds, then two for each upper bit, then three."""
    low, high = (1 << 32) - 1, ((1 << 32) - 1) << 32
    thirds = ((1 << 11) - 1, ((1 << 11) - 1) << 11, ((1 << 10) - 1) << 22)
    halves = ((1 << 16) - 1, ((1 << 16) - 1) << 16)
    whole_high = [high | third for third in thirds]
    wiped = [(high & ~(1 << (32 + bit))) | half for bit in range(32) for half in halves]
    whole_low = [low | (third << 32) for third in thirds]
    return whole_high + wiped + whole_low


def _keys(fp: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), fp.bitwiseAND(F.lit(_signed(mask))).alias("kept"))
            for kind, mask in enumerate(_masks())
        ]
    )


def linked_fingerprints(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """``(a, b)`` with a < b: all pairs of distinct fingerprints that differ in one or two bits.

    ``fingerprints`` must hold each value once. Pairs are compared where their keys are equal,
    and only those within two bits leave the join. A pair comes out up to three times. A value
    has at most 2,080 partners, so the result grows in proportion to the input.
    """
    keyed = fingerprints.select(F.col(fp).alias("a"), F.inline(_keys(F.col(fp))))
    other = fingerprints.select(F.col(fp).alias("b"), F.inline(_keys(F.col(fp))))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # Under a wiped bit only pairs that differ there count; the others meet under whole segments.
    bit = F.shiftright(F.col("kind") - 3, 1) + 32
    wiped = F.col("kind").between(3, 66)
    there = F.call_function("shiftright", differ, bit).bitwiseAND(F.lit(1)) == 1
    return keyed.join(other, ["kind", "kept"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(differ) <= MAX_BITS) & (~wiped | there)
    ).select("a", "b")


def fingerprint_classes(marked: DataFrame, fp: str, by: Sequence[str] | str) -> DataFrame:
    """``(fp, first)``: each distinct fingerprint with the smallest ``by`` of its class.

    ``marked`` is any table with a fingerprint column. Classes are the connected components of
    fingerprints within two bits. The smallest value ignores NULL and is NULL where all are.
    The result is checkpointed, one row per distinct fingerprint.
    """
    least = checkpointed(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(by).alias("first")))
    belongs = components(linked_fingerprints(least), "a", "b")
    joined = checkpointed(
        least.join(belongs.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("component")
        )
    )
    firsts = checkpointed(joined.groupBy("component").agg(F.min("first").alias("class_first")))
    return checkpointed(joined.join(firsts, "component").select("fp", F.col("class_first").alias("first")))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row for every row of ``docs``.

    ``fingerprint`` is a signed long, ``component_id`` the smallest doc_id that can be reached
    over fingerprints differing in at most two bits (NULL where the whole class has none). Rows
    with NULL ids take part. Extra columns are ignored; an empty table gives an empty result.
    """
    marked = checkpointed(
        with_fingerprint(
            docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words, keep=["doc_id"]
        )
    )
    classes = fingerprint_classes(marked, "fingerprint", "doc_id").withColumnRenamed("fp", "fingerprint")
    return marked.join(classes, "fingerprint").select(
        "doc_id", "fingerprint", F.col("first").alias("component_id")
    )


def segment_signatures(distinct: np.ndarray, mean: int = 6, used: int = 16) -> np.ndarray:
    """Signatures of shares of a text's sorted distinct shingle hashes.

    Shingles are dealt by hash to as many shares as give ``mean`` each, and the SimHashes of the
    first ``used`` shares become signatures. The number of shares is a power of two, so that
    texts of similar length agree on it; near a change of it, both numbers count.
    """
    made = []
    if len(distinct):
        odd = np.uint64(0x9E3779B97F4A7C15)
        level = math.log2(max(len(distinct) / mean, 1))
        for shares in sorted({1 << round(level - 0.25), 1 << round(level + 0.25)}):
            share = (distinct * odd >> np.uint64(40)) & np.uint64(shares - 1)
            order = np.argsort(share, kind="stable")
            order = order[: np.searchsorted(share[order], used)]
            heads = np.flatnonzero(np.append(True, np.diff(share[order]) != 0)) if len(order) else order
            # Share, number of shares and size are part of the signature.
            sizes = np.diff(np.append(heads, len(order))).astype(np.uint64)
            name = share[order[heads]] * np.uint64(1 << 40) + np.uint64(shares << 20) + sizes
            made.append(majority_bits(distinct[order], heads) ^ (name + np.uint64(1)) * odd)
    return np.unique(np.concatenate(made)) if made else np.zeros(0, np.uint64)


def rarest_shingles(distinct: np.ndarray, loads: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of which two sets of that similarity must share one: each set's rarest.

    Both sets hold the ``similarity`` part of either in common, so the first common one, in any
    order that all sets keep, is among the ``len - ceil(similarity * len) + 1`` first. ``loads``
    only makes the order useful: it counts the shingles of all texts in cells.
    """
    wanted = len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1
    return distinct[np.lexsort((distinct, loads[distinct & np.uint64(len(loads) - 1)]))[:wanted]]


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run."""
    return np.unique(run_hashes(found, words))


def drop_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    print_words: Sequence[int] = (SHINGLE_WORDS,),
) -> DataFrame:
    """Keep one row of each group of near-duplicates, with the columns of ``docs``.

    Texts link if their fingerprints (see ``with_fingerprint``) over runs of any of
    ``print_words`` words differ in at most two bits: the links of ``simhash_groups``, found in the same
    way. They also link if their sets of ``words``-word shingles have a Jaccard similarity of at
    least ``similarity``. Exact copies do both; groups are the connected components of all
    links. Of a group the row with the smallest id stays (NULL ids come last, then any one row).
    Blank texts are one group.

    Of the pairs with a similarity of 0.8 or more only about three in a hundred have
    fingerprints within two bits, so texts have further keys. Up to
    ``SHORT`` distinct shingles they are the rarest ones, and no pair of such texts is missed.
    The shingles of longer texts are dealt to segments by hash and each segment's own SimHash is a
    key: an unchanged segment is an equal signature. A pair of which one text is longer than
    ``SHORT`` and all segments differ is missed (at a similarity of 0.8 and 16 segments of 6
    shingles about one in three hundred), unless its fingerprints link it.

    Texts of an equal key are first compared with the one of smallest id and with their
    neighbours in the sorted order. Wherever that has not joined a whole group, all its texts
    that are not joined yet are compared with one another, in pairs of blocks. Similarities are exact.
    """
    columns = docs.columns
    names = ("prints", "whole", "amount", "short", "signatures")
    prints, whole, amount, short, signatures = (free_name(docs, name) for name in names)

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        marks, wholes, amounts, shorts, shares = [], [], [], [], []
        for t in arrays[0].to_pylist():
            found = words_of(t)
            hashes = {n: run_hashes(found, n) for n in {words, *print_words}}
            distinct = np.unique(hashes[words])
            marks.append(np.array([print_of_runs(hashes[n]) for n in print_words], np.uint64).view(np.int64))
            wholes.append(xxhash.xxh128_digest(b" ".join(found), SEED))
            amounts.append(len(distinct))
            shorts.append((distinct if len(distinct) <= SHORT else distinct[:0]).view(np.int64))
            # A partner of a text beyond SHORT has at least the similar part of it.
            long = len(distinct) >= math.floor(similarity * SHORT)
            shares.append((segment_signatures(distinct) if long else distinct[:0]).view(np.int64))
        return [
            pa.array(marks, pa.list_(pa.int64())),
            pa.array(wholes, pa.binary()),
            pa.array(amounts, pa.int64()),
            pa.array(shorts, pa.list_(pa.int64())),
            pa.array(shares, pa.list_(pa.int64())),
        ]

    made = {prints: "array<long>", whole: "binary", amount: "long", short: "array<long>", signatures: "array<long>"}
    marked = append_columns(docs, [text], made, work, keep=[doc_id])
    rank = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"))
    alike = [F.first(made_name).alias(name) for made_name, name in zip((prints, amount, short, signatures), (names[0], *names[2:]), strict=True)]
    # Equal texts are one from here on: 128 bits tell texts apart. The checkpoint fixes their numbers.
    texts = checkpointed(marked.groupBy(F.col(whole).alias("digest")).agg(F.min(rank).alias("rank"), *alike))
    texts = texts.withColumn("whole", F.monotonically_increasing_id())
    close = checkpointed(_print_links(texts, len(print_words)))
    shared = _shared_keys(texts, similarity)
    pairs = checkpointed(_candidates(shared))
    ends = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("whole")).distinct().join(texts, "whole").select("whole", "digest", "rank.id"))
    shingled = checkpointed(_shingle_sets(docs, ends, doc_id, text, words))
    links = checkpointed(_verified(pairs, shingled, similarity)).unionAll(close)
    joined = components(links, "a", "b").withColumnRenamed("node", "whole")
    # A stored table: a checkpoint keeps the plan's estimated sizes, whose digits every join adds up.
    stored = f"{ensure_checkpoint_dir(docs.sparkSession)}/links-{uuid.uuid4()}"
    _rest_of_groups(shared, joined, shingled, similarity).write.parquet(stored)
    more = read_trips(docs.sparkSession, stored)
    if not more.isEmpty():
        joined = _joined_further(joined, more)
    named = texts.select("whole", "digest", "rank").join(joined, "whole", "left")
    groups = named.groupBy(F.coalesce("component", "whole")).agg(
        F.min(F.struct("rank.no_id", "rank.id", "whole", "digest")).alias("first")
    )
    winners = checkpointed(groups.select(F.col("first.id").alias("win_id"), F.col("first.digest").alias("win_whole")))
    rows = _with_digest(docs, text, whole)
    kept = rows.join(
        winners, (F.col(whole) == F.col("win_whole")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("win_id")), "left_semi"
    )
    return kept.dropDuplicates([whole, doc_id]).select(*[F.col(f"`{c}`") for c in columns])


def _with_digest(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the 128-bit digest of each text's words."""

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([xxhash.xxh128_digest(b" ".join(words_of(t)), SEED) for t in arrays[0].to_pylist()], pa.binary())]

    return append_columns(docs, [text], {out: "binary"}, work)


def _print_links(texts: DataFrame, kinds: int) -> DataFrame:
    """``(a, b)``: links that join the texts of each class by each kind of fingerprint.

    Texts of one fingerprint link to the first of them, and the first ones of linked
    fingerprints to each other. Classes aren't made here: what follows the links joins them with all others.
    """
    marked = texts.select(F.posexplode("prints").alias("print_kind", "fp"), "whole")
    least = checkpointed(marked.groupBy("print_kind", "fp").agg(F.min("whole").alias("first")))
    pairs = None
    for kind in range(kinds):
        found = linked_fingerprints(least.where(F.col("print_kind") == kind).select("fp")).withColumn("print_kind", F.lit(kind))
        pairs = found if pairs is None else pairs.unionAll(found)
    low, high = least.toDF("print_kind", "a", "low"), least.toDF("print_kind", "b", "high")
    across = pairs.distinct().join(low, ["print_kind", "a"]).join(high, ["print_kind", "b"])
    copies = marked.join(least, ["print_kind", "fp"]).where("whole <> first")
    return across.select(F.col("low").alias("a"), F.col("high").alias("b")).unionAll(copies.select("whole", "first"))


def _joined_further(joined: DataFrame, more: DataFrame) -> DataFrame:
    """``(whole, component)``: the components ``joined`` after the links ``more`` between them.

    Only components with such links are looked at again, each as one node.
    """
    low, high = joined.toDF("a", "a_root"), joined.toDF("b", "b_root")
    ends = more.join(low, "a", "left").join(high, "b", "left")
    merged = components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "a", "b")
    above = merged.toDF("component", "further")
    renamed = joined.join(above, "component", "left").select("whole", F.coalesce("further", "component").alias("component"))
    return renamed.unionAll(merged.select(F.col("node").alias("whole"), "component"))


def _shared_keys(texts: DataFrame, similarity: float) -> DataFrame:
    """``(key, whole, amount, hub)``: the texts of every key that several have; ``hub`` has the smallest id.

    Keys are rarest shingles and segments.
    """
    cell = F.col("shingle").bitwiseAND(F.lit(CELLS - 1)).alias("cell")
    counted = checkpointed(texts.select(F.explode("short").alias("shingle")).groupBy(cell).agg(F.count(F.lit(1)).alias("n")))
    loads = np.zeros(CELLS, np.int64)
    found = counted.toArrow()  # at most CELLS rows, not as Python objects
    loads[found["cell"].to_numpy()] = found["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(loads)

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        rare = [
            rarest_shingles(np.array(found, np.int64).view(np.uint64), sent.value, similarity).view(np.int64)
            for found in arrays[0].to_pylist()
        ]
        return [pa.array(rare, pa.list_(pa.int64()))]

    slim = append_columns(texts, ["short"], {"rare": "array<long>"}, work, keep=["whole", "rank", "amount", "signatures"])
    keyed = checkpointed(slim.select(F.explode(F.concat("rare", "signatures")).alias("key"), F.col("rank.id").alias("id"), "whole", "amount"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "whole")
    first = checkpointed(
        keyed.groupBy("key").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.whole").alias("hub"))
    )
    return checkpointed(keyed.select("key", "whole", "amount").join(first, "key"))


def _candidates(shared: DataFrame) -> DataFrame:
    """``(a, b)`` with a < b: the pairs that are compared first."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            a, b = [], []
            for key, whole in zip(batch["key"].to_pylist(), batch["whole"].to_pylist(), strict=True):
                if key == last_key:
                    a.append(last)
                    b.append(whole)
                last_key, last = key, whole
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    beside = shared.select("key", "whole").orderBy("key", "whole").mapInArrow(neighbours, "a long, b long")
    every = shared.select(F.col("hub").alias("a"), F.col("whole").alias("b")).unionAll(beside)
    return every.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compare_cell(
    whole: np.ndarray, part: np.ndarray, rows: np.ndarray, columns: np.ndarray, sets: list[np.ndarray], similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)`` of the texts of one pair of blocks that link to texts of another part.

    All ``rows`` are compared with all ``columns``, exactly; pairs of one part are joined already.
    """
    apart = part[rows][:, None] != part[columns][None, :]
    none = np.zeros(0, np.int64)
    if not apart.any():
        return none, none
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    numbers = np.cumsum(several) - 1
    used = several[at]
    owner, at = owner[used], numbers[at[used]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros(apart.shape, np.float32)
    for low in range(0, int(several.sum()), 2048):
        here = slice(*np.searchsorted(at, (low, low + 2048)).tolist())
        has = np.zeros((len(sets), min(2048, int(several.sum()) - low)), np.float32)
        has[owner[here], at[here] - low] = 1
        both += has[rows] @ has[columns].T
    either = sizes[rows][:, None] + sizes[columns][None, :] - both.astype(np.int64)
    linked = apart & (both.astype(np.int64) >= similarity * either)
    if not linked.any():
        return none, none
    low, high = local_roots(linked, whole[rows], whole[columns])
    some_rows, some_columns = linked.any(axis=1), linked.any(axis=0)
    return (
        np.concatenate([whole[rows][some_rows], whole[columns][some_columns]]),
        np.concatenate([low[some_rows], high[some_columns]]),
    )


def _rest_of_groups(shared: DataFrame, joined: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: what links texts of an equal key that ``joined`` has in different components.

    Each group's largest component is compared with the rest, and the rest with itself: in pairs of
    blocks, of which only texts with links leave a task, with the root they reach there. Groups
    of the same texts are compared once, and small groups are gathered so that a call has many.
    """
    members = checkpointed(
        shared.join(joined, "whole", "left").select("key", "whole", "amount", F.coalesce("component", "whole").alias("part"))
    )
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "whole")).alias(f"mark{seed}") for seed in (0, 1)]
    parts = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), *marks)
    groups = (
        parts.groupBy("key")
        .agg(
            F.max(F.struct("n", "part", "amount")).alias("main"),
            F.sum("n").alias("n"),
            F.sum("amount").alias("amount"),
            F.bit_xor("mark0").alias("mark0"),
            F.bit_xor("mark1").alias("mark1"),
            F.count(F.lit(1)).alias("parts"),
        )
        # Two texts have been compared.
        .where("parts > 1 and n > 2")
        .groupBy("n", "mark0", "mark1")
        .agg(F.min(F.struct("key", "main", "amount")).alias("of"))
    )

    def blocks(rows: Column, amount: Column) -> Column:
        return F.ceil(F.greatest(rows / BLOCK_ROWS, amount / BLOCK_SHINGLES)).cast("int")

    groups = checkpointed(
        groups.select(
            "of.key",
            F.col("of.main.part").alias("main"),
            F.col("n").alias("n"),
            F.col("of.amount").alias("total"),
            blocks(F.col("n") - F.col("of.main.n"), F.col("of.amount") - F.col("of.main.amount")).alias("rests"),
            blocks(F.col("of.main.n"), F.col("of.main.amount")).alias("mains"),
        )
    )
    small = (F.col("rests") == 1) & (F.col("mains") == 1)
    load = groups.where(small).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    buckets = math.ceil(max(load[0] / (2 * BLOCK_ROWS), load[1] / BLOCK_SHINGLES, 1))
    salt, is_main = F.xxhash64("whole", "key"), F.col("part") == F.col("main")
    block = F.when(is_main, F.col("rests") + F.pmod(salt, "mains")).otherwise(F.pmod(salt, "rests")).cast("int")
    last = F.when(is_main, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1
    first, second = F.least("block", "other"), F.greatest("block", "other")
    bucket = F.when(small, F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(F.xxhash64("key", first, second))
    cells = (
        members.join(groups, "key")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select("key", "whole", "part", "block", first.alias("first"), second.alias("second"), bucket.alias("bucket"))
        .join(sets, "whole")
    )

    def compare(group: pa.Table) -> pa.Table:
        key, whole, part, block, first, second = (
            group[name].to_numpy() for name in ("key", "whole", "part", "block", "first", "second")
        )
        found = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        order = np.lexsort((second, first, key))
        cell = np.stack([key, first, second])[:, order]
        nodes, roots = [], []
        for at in np.split(order, np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1):
            rows, columns = np.flatnonzero(block[at] == first[at]), np.flatnonzero(block[at] == second[at])
            made = compare_cell(whole[at], part[at], rows, columns, [found[i] for i in at.tolist()], similarity)
            nodes.append(made[0])
            roots.append(made[1])
        return pa.table({"a": pa.array(np.concatenate(nodes), pa.int64()), "b": pa.array(np.concatenate(roots), pa.int64())})

    return cells.groupBy("bucket").applyInArrow(compare, "a long, b long")


def _shingle_sets(docs: DataFrame, ends: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``(whole, shingles)``: the sorted distinct shingle hashes of one row for each wanted text."""
    slim = _with_digest(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", "of")
    wanted = ends.select("whole", F.col("digest").alias("want"), F.col("id").alias("want_id"))
    rows = slim.join(wanted, (F.col("of") == F.col("want")) & F.col("id").eqNullSafe(F.col("want_id")))

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([shingle_hashes(words_of(t), words).tobytes() for t in arrays[0].to_pylist()], pa.binary())]

    sets = append_columns(rows, ["text"], {"shingles": "binary"}, work, keep=["whole"])
    return sets.dropDuplicates(["whole"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""
    a_sets, b_sets = sets.toDF("a", "a_set"), sets.toDF("b", "b_set")
    joined = pairs.join(a_sets, "a").join(b_sets, "b").select("a", "b", "a_set", "b_set")

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        made = []
        for x, y in zip(arrays[0].to_pylist(), arrays[1].to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            either = len(p) + len(q) - both
            made.append(both >= similarity * either if either else True)
        return [pa.array(made, pa.bool_())]

    return append_columns(joined, ["a_set", "b_set"], {"near": "boolean"}, work, keep=["a", "b"]).where("near").select("a", "b")
