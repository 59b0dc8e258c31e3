"""Byte-level BPE: encode each distinct word once and join the ids back by position.

Documents are taken in blocks of bounded size. A block explodes its texts into pre-tokens and
keeps its distinct ones, so that a word travels once per block. All blocks' words are shuffled
by word; rows of one word then lie side by side and the word is merged once. Its ids go back
to the blocks that asked for it, where the documents are put together by position.

Positions, places and ids travel as compressed planes of bytes, many documents to a row: they
are most of what is shuffled, and a block's share of them must fit beside its dictionary.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tripkit.llm.common import append_columns, release, releasing

BLOCK_CHARS = 1 << 25
_WORDS_PER_ROW = 1 << 16
_TOKENS_PER_ROW = 1 << 16
_ROWS_PER_PACK = 1 << 19
# What a row adds to its characters in a block, and to its tokens in a packed row: empty texts count.
_ROW_CHARS, _ROW_TOKENS = 64, 4
_WORDS, _POSITIONS = 0, 1


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks in the text of a ``.tiktoken`` file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def whole_word_encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Encodes a text as one pre-token, whatever it holds."""
    return tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, .. of every run, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def squeeze(*numbers: np.ndarray) -> bytes:
    """Compress arrays of non-negative integers below 2**32, each cut into its four planes of bytes."""
    head = np.array([len(n) for n in numbers], "<u4").tobytes()
    planes = [n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for n in numbers]
    return zlib.compress(head + b"".join(planes), 1)


def unsqueeze(payload: bytes, arrays: int) -> list[np.ndarray]:
    """What ``squeeze`` was given."""
    data = np.frombuffer(zlib.decompress(payload), np.uint8)
    at, found = 4 * arrays, []
    for size in data[:at].view("<u4").tolist():
        planes = data[at : at + 4 * size].reshape(4, size)
        found.append(np.ascontiguousarray(planes.T).view("<u4").reshape(size))
        at += 4 * size
    return found


class _Numbers(dict):
    """Numbers its keys from 0 in order of appearance."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _packed(numbers: Iterable[int]) -> bytes:
    """The numbers, below 2**32, in four bytes each."""
    return array("I", numbers).tobytes()


class _Pieces(dict):
    """The words that each piece of text consists of: their numbers, packed.

    Bytes instead of small NumPy arrays: what NumPy keeps of those lies between the pieces, and
    the memory around it would stay with the worker after the block.
    """

    def __init__(self, split: Callable[[str], list[str]], words: _Numbers, before: str):
        self.split, self.words, self.before = split, words, before

    def __missing__(self, piece: str) -> bytes:
        self[piece] = found = _packed([self.words[word] for word in self.split(self.before + piece)])
        return found


class Block:
    """The distinct words of some documents, and each document as a sequence of them."""

    def __init__(self, split: Callable[[str], list[str]], place: str = ""):
        self.split, self.words, self.place = split, _Numbers(), place
        # A word may start with one space, so a space between two other characters ends a word
        # for sure. Texts are cut there, and each distinct cut is split into words once.
        self.spaced: _Pieces | None = _Pieces(split, self.words, " ")
        self.chars = 0
        self.done: list[tuple[list, bytes]] = []
        self.ids: list = []
        self.positions: list[bytes] = []
        self.pending = 0

    def add(self, doc_id, text: str, doubtful: Callable[[str], object]) -> None:
        self.chars += len(text) + _ROW_CHARS
        if doubtful(text):
            found = _packed([self.words[w] for w in self.split(text)])
        else:
            first, *rest = text.split(" ")
            head = _packed([self.words[w] for w in self.split(first)])
            found = head + b"".join(map(self.spaced.__getitem__, rest))
        self.ids.append(doc_id)
        self.positions.append(found)
        self.pending += len(found) // 4 + _ROW_TOKENS
        if self.pending >= _TOKENS_PER_ROW:
            self.pack()

    def pack(self) -> None:
        """Put the documents at hand into one row: their ids, lengths and positions."""
        if self.ids:
            lengths = np.array([len(p) // 4 for p in self.positions])
            self.done.append((self.ids, squeeze(lengths, np.frombuffer(b"".join(self.positions), np.uint32))))
            self.ids, self.positions, self.pending = [], [], 0

    def rows(self) -> Iterator[tuple]:
        """``(block, kind, first, doc_ids, payload)``; a block's name has the hash of its words, and where it was cut.

        Blocks of equal words have different names, so a repeated text doesn't lead them into one task.
        """
        self.pack()
        self.spaced = None  # No text follows, and the words are made into bytes next.
        words = [word.encode("utf-8") for word in self.words]
        name = xxhash.xxh64(digest_input := b"\0".join(words)).intdigest()
        name = xxhash.xxh64(f"{name}:{len(digest_input)}:{self.place}").intdigest()
        name = np.uint64(name).view(np.int64).item()
        for first in range(0, len(words), _WORDS_PER_ROW):
            part = words[first : first + _WORDS_PER_ROW]
            sizes = np.array([len(w) for w in part], "<u4").tobytes()
            yield name, _WORDS, first, None, zlib.compress(sizes + b"".join(part), 1)
        for ids, payload in self.done:
            yield name, _POSITIONS, 0, ids, payload


def _unpack_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, word, place)`` for each distinct word of each block."""
    for batch in batches:
        rows = batch.select(["block", "kind", "first", "payload"]).filter(pc.equal(batch["kind"], _WORDS))
        for row in rows.to_pylist():
            data = zlib.decompress(row["payload"])
            # The sizes fill the front; they add up to what is behind them.
            sizes = np.frombuffer(data, "<u4", count=_count_words(data))
            body = data[4 * len(sizes) :]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            words = pa.Array.from_buffers(
                pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)]
            )
            places = np.arange(row["first"], row["first"] + len(sizes), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), row["block"], np.int64)), words, pa.array(places)],
                names=["block", "word", "place"],
            )


def _count_words(data: bytes) -> int:
    """How many sizes stand before the words they measure."""
    sizes = np.frombuffer(data, "<u4", count=len(data) // 4)
    reach = np.cumsum(sizes, dtype=np.int64) + 4 * np.arange(1, len(sizes) + 1)
    return int(np.searchsorted(reach, len(data))) + 1


def _pack_ids(blocks: list, places: list, lengths: array, ids: array) -> Iterator[tuple[int, bytes]]:
    """One ``(block, payload)`` for each block: its words' places, numbers of ids, and ids."""
    block, place = np.concatenate(blocks), np.concatenate(places)
    length, flat = np.array(lengths, np.int64), np.array(ids, np.uint32)
    starts = np.cumsum(length) - length
    order = np.lexsort((place, block))
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for mine in np.split(order, cuts):
        steps = np.diff(place[mine], prepend=0)
        yield int(block[mine[0]]), squeeze(steps, length[mine], flat[ragged(starts[mine], length[mine])])


def _assemble(doc_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The cogroup of a block's documents with the ids of its words."""

    def work(block: pa.Table, packed: pa.Table) -> pa.Table:
        docs = block.filter(pc.equal(block["kind"], _POSITIONS))
        parts, size = [], 0
        for payload in packed["payload"].to_pylist():
            steps, lengths, ids = unsqueeze(payload, 3)
            parts.append((np.cumsum(steps, dtype=np.int64), lengths, ids))
            size = max(size, int(parts[-1][0][-1]) + 1)
        length, start = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        at = 0
        for place, lengths, ids in parts:
            length[place] = lengths
            start[place] = at + np.cumsum(lengths, dtype=np.int64) - lengths
            at += len(ids)
        flat = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
        doc_ids: list = []
        made, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for ids, payload in zip(docs["doc_ids"].to_pylist(), docs["payload"].to_pylist(), strict=True):
            lengths, words = unsqueeze(payload, 2)
            if len(words) and (int(words.max()) >= size or (length[words] < 0).any()):
                raise ValueError("a block and its words differ: the input changed while it was read")
            doc_ids += ids
            reach = np.concatenate([[0], np.cumsum(length[words])])
            ends = reach[np.cumsum(lengths, dtype=np.int64)]
            sizes.append(np.diff(ends, prepend=0))
            made.append(flat[ragged(start[words], length[words])])
        values, offsets = np.concatenate(made), np.cumsum(np.concatenate(sizes)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        return pa.table({"doc_id": pa.array(doc_ids, doc_type), "ids": lists})

    def released(block: pa.Table, packed: pa.Table) -> pa.Table:
        made = work(block, packed)
        release()
        return made

    return released


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(doc_id, ids)``: the ids of each text as an int array, in the rows' multiplicity.

    ``vocabulary`` is the path of a ``.tiktoken`` rank file, read on the driver and broadcast
    (its size is that of the vocabulary, not of the data); ``pattern`` cuts texts into
    pre-tokens, each encoded by itself, without special tokens. NULL and empty texts have no
    ids. Ids may repeat or be NULL; extra columns are ignored; no rows give no rows.

    A block holds the documents of one input partition up to about ``block_chars``
    characters, or one longer document; a row counts as ``_ROW_CHARS`` more, so empty texts fill blocks too. Blocks are shuffled once, and both the words and the
    documents are taken from that shuffle.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    with open(vocabulary, "rb") as lines:
        ranks = spark.sparkContext.broadcast(lines.read())
    doc_kind = chosen.schema["doc_id"].dataType.simpleString()
    tagged_schema = f"block long, kind int, first int, doc_ids array<{doc_kind}>, payload binary"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        # A space beside other white space, by any notion of white space.
        doubtful = regex.compile(r"[\s\x1c-\x1f\x85] | [\s\x1c-\x1f\x85]").search
        kind = None

        def finish(block: Block) -> Iterator[pa.RecordBatch]:
            rows = list(block.rows())
            for at in range(0, len(rows), 32):
                names, kinds, firsts, ids, payloads = zip(*rows[at : at + 32], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(kinds, pa.int32()),
                        pa.array(firsts, pa.int32()),
                        pa.array(ids, pa.list_(kind)),
                        pa.array(payloads, pa.binary()),
                    ],
                    names=["block", "kind", "first", "doc_ids", "payload"],
                )

        part_id, cuts = TaskContext.get().partitionId(), itertools.count()

        def opened() -> Block:
            return Block(split, f"{part_id}:{next(cuts)}")

        block = opened()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            # Few texts at a time: as Python strings they take as much memory as the batch again.
            for part in (batch.slice(at, 128) for at in range(0, batch.num_rows, 128)):
                for key, value in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    block.add(key, value or "", doubtful)
                    if block.chars >= block_chars:
                        yield from finish(block)
                        block = opened()
        if block.ids or block.done:
            yield from finish(block)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = whole_word_encoder(read_ranks(ranks.value))
        last, found = None, array("I")
        blocks, places, lengths, ids = [], [], array("q"), array("I")

        def packed() -> pa.RecordBatch:
            rows = list(_pack_ids(blocks, places, lengths, ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["block", "payload"],
            )

        for batch in batches:
            for word in batch["word"].to_pylist():
                if word != last:
                    last, found = word, array("I", encoder(word))
                lengths.append(len(found))
                ids.extend(found)
            # Copies: an array of the batch would keep the words, too.
            blocks.append(batch["block"].to_numpy().copy())
            places.append(batch["place"].to_numpy().copy())
            if len(lengths) >= _ROWS_PER_PACK:
                yield packed()
                blocks, places, lengths, ids = [], [], array("q"), array("I")
        if lengths:
            yield packed()

    tagged = chosen.mapInArrow(releasing(cut), tagged_schema).repartition("block")
    words = tagged.mapInArrow(_unpack_words, "block long, word string, place int")
    merged = (
        words.repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(releasing(merge), "block long, payload binary")
    )
    arrow_kind = to_arrow_type(chosen.schema["doc_id"].dataType)
    return (
        tagged.groupBy("block")
        .cogroup(merged.groupBy("block"))
        .applyInArrow(_assemble(arrow_kind), f"doc_id {doc_kind}, ids array<int>")
    )


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` plus the bytes that its ids stand for.

    The token-byte table has a row for each id, in id order, so it is joined by position: it
    is broadcast once (its size is that of the vocabulary) and every batch takes its rows
    from it. NULL and empty arrays give no bytes. An id outside the table is an error.
    """
    with open(vocabulary, "rb") as lines:
        ranks = encoded.sparkSession.sparkContext.broadcast(lines.read())
    if out.lower() in {name.lower() for name in encoded.columns}:
        raise ValueError(f"{out} is already a column")

    def token_table() -> pa.Array:
        tokens = read_ranks(ranks.value)
        table: list[bytes | None] = [None] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            table[rank] = token
        return pa.array(table, pa.large_binary())

    def joined(lists: pa.Array, tokens: pa.Array) -> pa.Array:
        if lists.null_count:
            lists = pc.fill_null(lists, pa.scalar([], lists.type))
        taken = tokens.take(lists.flatten())
        if taken.null_count:
            raise ValueError("an id has no token")
        if not len(taken):
            return pa.array([b""] * len(lists), pa.binary())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(False))])
        # The taken tokens lie one behind the other, and so do the texts they make up.
        _, reach, data = taken.buffers()
        spans = np.frombuffer(reach, np.int64, len(taken) + 1)[ends].tolist()
        return pa.array([data[a:b].to_pybytes() for a, b in zip(spans, spans[1:])], pa.binary())

    held: list[pa.Array] = []

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        if not held:
            held.append(token_table())
        return [joined(columns[0], held[0])]

    return append_columns(encoded, [ids], {out: "binary"}, work, at_once=256)
