"""Nearest neighbours by counting hash collisions.

Every row of the index lies in a shard. A shard keeps one sorted array for each random
projection. A query looks, in each array, at a window centred on its own projection; a vector
inside the window collides with the query. Vectors that collide often enough are verified by
their exact inner product. Windows grow (virtual rehashing: the radius changes, the arrays do
not) until a vector as near as the worst of the verified ones would have collided often enough
with a known probability.

Largest inner products become smallest distances by one more coordinate: a row ``x`` of a
shard whose longest row has length ``M`` gets ``sqrt(M**2 - |x|**2)``, a query gets 0 and is
scaled to length ``M``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripkit.llm.common import numbered
from tripkit.operators.layout import checkpointed

TOP = 20
PROJECTIONS = 128
# A row is verified if it collides in this share of the projections.
COLLISIONS = 0.75
# So many standard deviations of the count lie between a row that must not be missed and the threshold.
MARGIN = 1.4
GROWTH = 1.3
FIRST_REACH = 0.85
SHARD_ROWS = 16_384
QUERY_ROWS = 512
# Blocks of queries that one task compares with a shard, and the most tasks for all of them.
LANE_BLOCKS = 2
MAX_TASKS = 20_000
# Queries whose windows are moved together: their counts fit a processor's cache.
AT_ONCE = 16


class Shard:
    """Sorted projections of one shard's rows, and the windows that queries open in them."""

    def __init__(self, rows: np.ndarray, projections: int, seed: int = 13):
        """``rows``: finite vectors, none zero, one per line."""
        scale = np.abs(rows).max()  # keeps squares from overflowing; orders stay the same
        self.scaled = rows / scale
        length2 = (self.scaled * self.scaled).sum(axis=1)
        self.longest = math.sqrt(length2.max())
        # How far the next queries' first windows reach. To begin with, a fifth of the largest
        # distance, which is twice the longest row; then a share of what earlier queries needed.
        self.first: float | None = None
        extra = np.sqrt(np.maximum(length2.max() - length2, 0.0))
        self.axes = np.random.default_rng([seed, rows.shape[1]]).normal(size=(projections, rows.shape[1] + 1))
        self.lifted = np.column_stack([self.scaled, extra])
        hashes = self.axes @ self.lifted.T
        order = np.argsort(hashes, axis=1, kind="stable")
        self.arrays = np.take_along_axis(hashes, order, axis=1)
        # The place of each row in each array: a window is a range of places.
        self.places = np.empty(order.shape, np.uint16 if len(rows) < 1 << 15 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(rows), dtype=self.places.dtype)[None, :], axis=1)

    def hashes(self, units: np.ndarray) -> np.ndarray:
        """Projections (queries by arrays) of queries of length 1."""
        return (units * self.longest) @ self.axes[:, :-1].T

    def counts(self, hashes: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Collisions (queries by rows) with windows that reach so far to both sides."""
        kind, shape = self.places.dtype, (len(hashes), self.places.shape[1])
        made = np.zeros(shape, np.uint8 if len(self.arrays) < 256 else np.uint16)
        ahead, inside = np.empty(shape, kind), np.empty(shape, bool)
        for i, array in enumerate(self.arrays):
            low = np.searchsorted(array, hashes[:, i] - reach, "left")
            wide = np.searchsorted(array, hashes[:, i] + reach, "right") - low
            # Unsigned: places before the window wrap round to large numbers.
            np.subtract(self.places[i][None, :], low.astype(kind)[:, None], out=ahead)
            np.less(ahead, wide.astype(kind)[:, None], out=inside)
            made += inside.view(np.uint8)
        return made

    def search(self, units: np.ndarray, own: list[np.ndarray], top: int, share: float, margin: float, growth: float) -> list[np.ndarray]:
        """The verified rows of each query, with the ``top`` nearest among them.

        ``own`` has the rows that are the query itself. A query is done when ``top`` rows are
        verified and its windows reach far enough for the worst of these, or all rows are verified.
        """
        projections, size = len(self.axes), len(self.scaled)
        threshold = math.ceil(share * projections)
        sure = min(0.999, share + margin * math.sqrt(share * (1 - share) / projections))
        needed = NormalDist().inv_cdf((1 + sure) / 2)
        hashes = self.hashes(units)
        reach = np.full(len(units), self.first if self.first is not None else 0.4 * self.longest * needed)
        seen = [np.zeros(0, np.int64)] * len(units)
        liked = [np.zeros(0)] * len(units)
        active = np.arange(len(units))
        while len(active):
            counts = self.counts(hashes[active], reach[active])
            still = []
            for at, q in enumerate(active.tolist()):
                hit = np.flatnonzero(counts[at] >= threshold)
                fresh = np.setdiff1d(hit, seen[q], assume_unique=True) if len(seen[q]) else hit
                fresh = fresh[~np.isin(fresh, own[q])] if len(own[q]) else fresh
                seen[q] = np.concatenate([seen[q], fresh])
                liked[q] = np.concatenate([liked[q], self.scaled[fresh] @ units[q]])
                if len(seen[q]) + len(own[q]) == size:
                    continue
                if len(seen[q]) < top:
                    reach[q] *= growth
                else:
                    worst = np.partition(liked[q], -top)[-top]
                    # Squared distance of the lifted vectors, from their inner product.
                    far = math.sqrt(max(2 * self.longest**2 - 2 * self.longest * worst, 0.0)) * needed
                    if reach[q] >= far:
                        continue
                    # On to what the worst row needs, a step at a time: it gets better on the way.
                    reach[q] = min(far, reach[q] * growth)
                still.append(q)
            active = np.array(still, np.int64)
        self.first = FIRST_REACH * float(np.median(reach))
        return [self._nearest(s, v, top) for s, v in zip(seen, liked, strict=True)]

    @staticmethod
    def _nearest(seen: np.ndarray, liked: np.ndarray, top: int) -> np.ndarray:
        """Rows that may be among the ``top`` when scored exactly, all ties included."""
        if len(seen) <= top:
            return seen
        worst = np.partition(liked, -top)[-top]
        return seen[liked >= worst - 1e-9 * max(1.0, abs(worst))]


def _best(score: np.ndarray, ids: np.ndarray, known: np.ndarray, number: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` in the order of results: score, then id (unknown last), then number."""
    return np.lexsort((number, ids, ~known, -score))[:top]


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    every: int = 20,
    top: int = TOP,
    projections: int = PROJECTIONS,
    collisions: float = COLLISIONS,
    margin: float = MARGIN,
    growth: float = GROWTH,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` rows found with the largest inner product.

    The queries are the rows whose id is divisible by ``every``, or those of ``queries`` (same
    columns), which are no candidates then. Candidates are all rows but the query's own; the other rows that share its
    id or vector are candidates. Ids are integers; a NULL id is a candidate and never a query. Vectors that
    are NULL, empty or zero, or hold NULL or non-finite entries, take no part. Vectors are
    compared with those of the same length only. ``score`` is the inner product of the vectors
    as stored, in double precision (it can overflow to infinity). Ranks count from 1; ties go
    to the smaller id, NULL last. A query gets all candidates if there are fewer, and no row if
    there are none. A repeated query row is a query of its own.

    Every row is indexed and nothing is sampled. Rows are numbered and dealt to shards of
    ``shard_rows`` by number, so a hot vector or id is spread. Each block of queries meets each
    shard in a task, which returns ``top`` rows a query. A neighbour is missed if its
    collisions fall short of ``collisions`` times ``projections`` by chance: about one
    in twelve with ``margin`` 1.4 for the last of the ``top``, far fewer for nearer ones.
    """
    entries = F.col(embedding)
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    sound = F.coalesce(finite & F.exists(entries, lambda c: c != 0), F.lit(False))

    def clean(df: DataFrame) -> DataFrame:
        kind = df.schema[embedding].dataType
        narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
        vector = entries.cast("array<float>" if narrow else "array<double>").alias("vector")
        return numbered(df.where(sound).select(F.col(vec_id).cast("long").alias("id"), vector), "number")

    rows = clean(vectors)
    asked = rows.where(F.col("id") % every == 0) if queries is None else clean(queries)
    same = queries is None

    def packed(df: DataFrame, block_rows: int, name: str) -> tuple[DataFrame, int]:
        """Blocks of equal vector length, ``(dims, name, numbers, ids, raw)`` with vectors as doubles, and how many numbers they have."""
        kind = T.StructType().add("dims", T.IntegerType()).add(name, T.LongType())
        kind = kind.add("numbers", T.ArrayType(T.LongType())).add("ids", T.ArrayType(T.LongType())).add("raw", T.BinaryType())
        parts = max(1, -(-df.count() // block_rows))

        def pack(group: pa.Table) -> pa.Table:
            group = group.sort_by("number")
            raw = np.ascontiguousarray(group["vector"].combine_chunks().flatten().to_numpy(), "<f8").tobytes()
            lists = [pa.array([group[c].to_pylist()], pa.list_(pa.int64())) for c in ("number", "id")]
            return pa.table([group["dims"].slice(0, 1), group[name].slice(0, 1), *lists, pa.array([raw], pa.binary())], names=kind.names)

        dealt = df.select("number", "id", "vector", F.size("vector").alias("dims"), F.pmod("number", F.lit(parts)).cast("long").alias(name))
        return checkpointed(dealt.groupBy("dims", name).applyInArrow(pack, kind)), parts

    shards, n_shards = packed(rows, shard_rows, "shard")
    blocks, n_blocks = packed(asked, query_rows, "block")
    out = T.StructType()
    for name, kind in (("query", "long"), ("query_id", "long"), ("number", "long"), ("vec_id", "long"), ("score", "double")):
        out = out.add(name, T.DataType.fromDDL(kind))
    arrow = [pa.field(f.name, pa.float64() if f.name == "score" else pa.int64()) for f in out.fields]

    def probe(held: pa.Table, met: pa.Table) -> pa.Table:
        if not held.num_rows or not met.num_rows:
            return pa.schema(arrow).empty_table()
        dims, numbers, ids = held["dims"][0].as_py(), held["numbers"][0].values.to_numpy(), held["ids"][0].values
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        rows = np.frombuffer(held["raw"][0].as_py(), "<f8").reshape(-1, dims)
        shard = Shard(rows, projections)
        found: list[list] = [[] for _ in arrow]
        for block in range(met.num_rows):
            q_numbers, q_ids = met["numbers"][block].as_py(), met["ids"][block].as_py()
            asked = np.frombuffer(met["raw"][block].as_py(), "<f8").reshape(-1, dims)
            units = asked / np.abs(asked).max(axis=1, keepdims=True)
            units = units / np.sqrt((units * units).sum(axis=1, keepdims=True))
            for at in range(0, len(asked), AT_ONCE):
                part = range(at, min(at + AT_ONCE, len(asked)))
                own = [np.flatnonzero(numbers == q_numbers[q]) if same else np.zeros(0, np.int64) for q in part]
                nears = shard.search(units[at : at + AT_ONCE], own, top, collisions, margin, growth)
                for q, near in zip(part, nears, strict=True):
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = (rows[near] * asked[q]).sum(axis=1)  # row by row: equal vectors score alike
                    best = _best(score, ids[near], known[near], numbers[near], top)
                    near = near[best]
                    their = [i if k else None for i, k in zip(ids[near].tolist(), known[near].tolist(), strict=True)]
                    made = [q_numbers[q]] * len(near), [q_ids[q]] * len(near), numbers[near].tolist(), their, score[best].tolist()
                    for column, values in zip(found, made, strict=True):
                        column.extend(values)
        return pa.table([pa.array(c, f.type) for c, f in zip(found, arrow, strict=True)], schema=pa.schema(arrow))

    # Every block of queries meets every shard of vectors of its length: rows that hold blocks are
    # joined, not vectors. A shard is copied to each lane, and a task compares a lane with it.
    lanes = -(-n_blocks // LANE_BLOCKS)
    tasks = min(2 * lanes * n_shards, MAX_TASKS)
    keys = ["dims", "shard", "lane"]
    left = shards.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    right = blocks.withColumn("lane", F.pmod("block", F.lit(lanes)).cast("long")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))
    )
    found = (
        left.repartition(tasks, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(tasks, *keys).groupBy(*keys))
        .applyInArrow(probe, out)
    )
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "number")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
