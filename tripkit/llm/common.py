"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripkit.operators.layout import checkpointed

# What separates words, everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or ``wish`` with underscores in front until ``df`` has no such column (in any case)."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def release() -> None:
    """Give freed memory back to the machine.

    Python workers outlive their tasks, and what they keep for reuse is missing elsewhere on
    the executor. Does nothing where the C library has no such call.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, and then ``release``: by that time what ``work`` held is free, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; a plain join side beyond that.

    For checkpointed tables of narrow rows: they are counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``, a number from 0 without gaps, in no particular order.

    A checkpoint fixes the rows' partitions; a row's number is its place in its partition plus
    the sizes of those before. Only the table of partition sizes is broadcast.
    """
    part, place, size, before = (free_name(df, name) for name in ("part", "place", "size", "before"))
    made = F.monotonically_increasing_id()
    fixed = checkpointed(df.select("*", F.shiftright(made, 33).alias(part), made.bitwiseAND(F.lit((1 << 33) - 1)).alias(place)))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = fixed.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    offsets = sizes.select(part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    return fixed.join(F.broadcast(offsets), part).select(*[fixed[f"`{c}`"] for c in df.columns], (F.col(before) + F.col(place)).alias(out))


def word_count(text: Column) -> Column:
    """Number of words as a long; NULL counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame, *first: Column) -> Column:
    """A 64-bit hash of the row, for orders that must not change when a task runs again.

    Map and variant columns can't be hashed by Spark and are left out.
    """

    def hashable(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return hashable(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(hashable(field.dataType) for field in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return F.xxhash64(*first, *[df[f"`{f.name}`"] for f in df.schema.fields if hashable(f.dataType)])


def append_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: dict[str, str],
    work: Callable[[list[pa.Array]], list[pa.Array]],
    at_once: int = 1024,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (default: all) plus ``outputs`` (name to SQL type), made from ``inputs``.

    ``work`` gets the input arrays of an Arrow batch, ``at_once`` rows at most, and returns one
    array for each output. Names in ``outputs`` must not occur among the columns kept.
    """
    kept = list(df.columns if keep is None else keep)
    # Inside, columns go by number, whatever they are called.
    places = [df.columns.index(name) for name in [*kept, *inputs]]
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    used = numbered.select(*[f"c{i}" for i in dict.fromkeys(places)])
    kept_names, input_names = [f"c{i}" for i in places[: len(kept)]], [f"c{i}" for i in places[len(kept) :]]
    schema = T.StructType([used.schema[name] for name in kept_names])
    for i, kind in enumerate(outputs.values()):
        schema = schema.add(f"made{i}", T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                made = work([part.column(name) for name in input_names])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept_names), *made], names=schema.names)

    return used.mapInArrow(releasing(run), schema).toDF(*kept, *outputs)
