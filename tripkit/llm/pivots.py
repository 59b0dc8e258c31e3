"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), nearest first. Inverted
lists hold, for each label and pivot, the vectors that have it in their description. Vectors
that meet in a list and share enough pivots are candidates, and all candidates are verified
by their cosine. Long lists are cut into blocks, and pairs of blocks are compared, so that no
list is ever gathered in one task and no pair leaves the task that compared it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripkit.llm.common import append_columns
from tripkit.llm.components import components
from tripkit.operators.layout import checkpointed

THRESHOLD = 0.93
NEAREST = 8
SHARED = 2
PIVOTS_PER_ROOT = 2.0
MAX_PIVOTS = 1 << 15
BLOCK_ROWS = 1024


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors from their bytes, scaled to length 1 in double precision."""
    rows = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # keeps squares from overflowing
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def describe(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the ``nearest`` pivots of each vector, nearest first; ties to the smaller number."""
    near = min(nearest, len(pivots))
    made = np.empty((len(units), near), np.int32)
    for at in range(0, len(units), 512):
        likeness = units[at : at + 512] @ pivots.T
        made[at : at + 512] = np.argsort(-likeness, axis=1, kind="stable")[:, :near]
    return made


def local_roots(adjacent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row and each column reaches inside one block pair."""
    low, high = a.copy(), b.copy()
    far = np.int64(np.iinfo(np.int64).max)
    while True:
        new_high = np.minimum(high, np.where(adjacent, low[:, None], far).min(axis=0, initial=far))
        new_low = np.minimum(low, np.where(adjacent, new_high[None, :], far).min(axis=1, initial=far))
        if (new_low == low).all() and (new_high == high).all():
            return low, high
        low, high = new_low, new_high


def compare_blocks(group: pa.Table, kind: str, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, links, root)`` of the nodes that have links in one pair of blocks of one list.

    A pair counts in the list of the smallest pivot that both share, and nowhere else.
    """
    pivot = group["pivot"][0].as_py()
    node, times = group["node"].to_numpy(), group["times"].to_numpy()
    block = group["block"].to_numpy()
    first, second = group["first"][0].as_py(), group["second"][0].as_py()
    units = unit_rows(group["raw"].to_pylist(), kind)
    nearest = np.array(group["nearest"].to_pylist(), np.int64)
    names, at = np.unique(nearest, return_inverse=True)
    has = np.zeros((len(node), len(names)), np.float32)
    has[np.arange(len(node))[:, None], at.reshape(nearest.shape)] = 1
    rows, columns = np.flatnonzero(block == first), np.flatnonzero(block == second)
    common = has[rows] @ has[columns].T
    below = has[:, names < pivot]
    linked = (common >= min(shared, nearest.shape[1])) & (below[rows] @ below[columns].T == 0)
    linked &= units[rows] @ units[columns].T >= threshold
    if first == second:
        linked &= ~np.eye(len(rows), dtype=bool)
        counts = linked @ times[columns]
        mine, links = node[rows], counts
        roots, other = local_roots(linked, node[rows], node[columns])
        roots = np.minimum(roots, other)
    else:
        mine = np.concatenate([node[rows], node[columns]])
        links = np.concatenate([linked @ times[columns], times[rows] @ linked])
        roots = np.concatenate(local_roots(linked, node[rows], node[columns]))
    some = links > 0
    return mine[some], links[some], roots[some]


def embedding_groups(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    nearest: int = NEAREST,
    shared: int = SHARED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row for every row of ``vectors``.

    Rows link if their labels are equal and not NULL, their dimensions are equal and their
    cosine (double precision) is at least ``threshold``. Vectors that are NULL, empty or zero
    or that hold NULL or non-finite components link with nothing. ``n_links`` counts other rows,
    repeated rows and ids as they are. ``component_id`` is the smallest id reachable over
    links (NULL ids are ignored unless there is no other), ``kept`` whether it is the row's own.

    Equal vectors of a label are indexed once. The pivots are a sample by hash, about
    ``PIVOTS_PER_ROOT`` times the square root of the number of distinct vectors and at most
    ``MAX_PIVOTS``, which bounds what is broadcast; every vector is indexed. Links that share
    fewer than ``shared`` of their ``nearest`` pivots are missed; the tests measure how many.
    """
    kind = vectors.schema[embedding].dataType
    code = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    cast = "array<float>" if code == "<f4" else "array<double>"
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast(cast).alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))

    distinct = checkpointed(
        marked.where("sound")
        .groupBy("label", "embedding")
        .agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    )
    # The checkpoint fixes the partitions and so these numbers.
    nodes = checkpointed(distinct.withColumn("node", F.monotonically_increasing_id()))

    count = nodes.count()
    wanted = min(max(math.ceil(PIVOTS_PER_ROOT * math.sqrt(count)), 4 * nearest), MAX_PIVOTS)
    sample = nodes.orderBy(F.xxhash64("embedding"), "node").limit(wanted).select("embedding").collect()
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(len(row["embedding"]), []).append(row["embedding"])
    pivots = {
        size: unit_rows([np.array(v, code).tobytes() for v in found], code) for size, found in by_size.items()
    }
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        raw = [np.array(v, code).tobytes() for v in arrays[0].to_pylist()]
        width = np.dtype(code).itemsize
        sizes = np.array([len(r) // width for r in raw])
        near: list = [None] * len(raw)
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            if size in sent.value:
                made = describe(unit_rows([raw[i] for i in mine], code), sent.value[size], nearest)
            else:  # so few vectors of this size that none was sampled: they share one list
                made = np.full((len(mine), 1), -1, np.int32)
            for i, names in zip(mine.tolist(), made.tolist(), strict=True):
                near[i] = names
        return [pa.array(raw, pa.binary()), pa.array(near, pa.list_(pa.int32()))]

    described = append_columns(
        nodes, ["embedding"], {"raw": "binary", "nearest": "array<int>"}, work, keep=["node", "label", "times"]
    )
    described = checkpointed(described.withColumn("size", F.length("raw")))
    posted = described.withColumn("pivot", F.explode("nearest"))
    lists = checkpointed(
        posted.groupBy("label", "size", "pivot")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("label", "size", "pivot", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("node", "pivot"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = (
        posted.join(lists, ["label", "size", "pivot"])
        .withColumn("block", block)
        .select("*", other)
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
    )
    schema = "node long, links long, root long"

    def compare(group: pa.Table) -> pa.Table:
        node, links, root = compare_blocks(group, code, threshold, shared)
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    found = checkpointed(
        pairs.select("label", "size", "pivot", "first", "second", "block", "node", "times", "raw", "nearest")
        .groupBy("label", "size", "pivot", "first", "second")
        .applyInArrow(compare, schema)
    )
    belongs = components(found, "node", "root")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = checkpointed(
        nodes.join(totals, "node", "left")
        .join(belongs, "node", "left")
        .select(
            "node",
            "label",
            "embedding",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    least = checkpointed(facts.groupBy("component").agg(F.min("least").alias("component_id")))
    facts = checkpointed(
        facts.join(least, "component").select(
            F.col("label").alias("f_label"), F.col("embedding").alias("f_embedding"), "links", "component_id"
        )
    )
    linked = (
        marked.where("sound")
        .join(facts, (F.col("label") == F.col("f_label")) & (F.col("embedding") == F.col("f_embedding")))
        .select("vec_id", F.col("links").alias("n_links"), "component_id")
    )
    alone = marked.where(~F.col("sound")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
