"""Spelling variants through a dictionary of trie-node pairs.

The nodes of a trie of all words (their beginnings) and of a trie of the reversed words (their
ends) are numbered. Cutting a word at a place gives a pair of integers, the node before and
the node behind the cut; leaving out the letter at a place gives the pair of the nodes around
it. Words that differ by one replaced letter share the pair around that letter. A word from
which a letter is taken has, as its own cut, the pair around that letter. So equal pairs are
exactly the neighbours at one edit, and an alphabet's size bounds how many share one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripkit.llm.common import broadcast_if_small
from tripkit.operators.layout import checkpointed, with_position

# What a word is made of, and the capital letters that are lowered.
RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
DELETE_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
# Characters of a text that are split into words at once, and distinct words counted before they are passed on.
SLICE_CHARS = 1 << 20
HELD_WORDS = 1 << 17
HELD_CHARS = 1 << 24


def pieces(text: str, at_once: int = SLICE_CHARS) -> Iterator[str]:
    """``text`` in slices that end where no run does, so that no run is cut."""
    outside = re.compile("[^A-Za-zÀ-ÿ]")
    start = 0
    while start < len(text):
        end = outside.search(text, start + at_once)
        stop = end.start() if end else len(text)
        yield text[start:stop]
        start = stop


def changed(doc_id: str, run: str, every: int = DELETE_EVERY) -> str:
    """The run, without one of its letters if ``every`` divides the CRC of ``<doc_id>:<run>``."""
    mark = zlib.crc32(f"{doc_id}:{run}".encode())
    if mark % every:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = DELETE_EVERY, shortest: int = MIN_LENGTH) -> DataFrame:
    """``(word, n)``: occurrences of each word of at least ``shortest`` code points.

    Words are the runs of letters, A-Z lowered, with one letter of some runs deleted (see
    ``changed``; an id that is NULL counts as an empty one). NULL and empty texts have no words. Tasks count
    first, a bounded number of words at a time.
    """
    run = re.compile(RUN)

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch["id"][i].as_py() or ""
                for piece in pieces(batch["text"][i].as_py() or ""):
                    for word, n in Counter(run.findall(piece.translate(LOWER))).items():
                        word = changed(name, word, every)
                        if len(word) >= shortest:
                            if word not in held:
                                chars += len(word)
                            held[word] += n
                    if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                        yield flushed(held)
                        held, chars = Counter(), 0
        if held:
            yield flushed(held)

    slim = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return slim.where("text IS NOT NULL").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def digests(word: str) -> tuple[list[bytes], list[bytes]]:
    """Digests of all beginnings of a word and of all its ends, by length, in one pass each."""
    sides = []
    for side, letters in ((b"begin", word), (b"end", word[::-1])):
        state = blake2b(digest_size=16, person=side)
        made = [state.digest()]
        for letter in letters:
            state.update(letter.encode("utf-32-le", "surrogatepass"))
            made.append(state.digest())
        sides.append(made)
    return sides[0], sides[1]


def trie_nodes(words: DataFrame) -> DataFrame:
    """``(id, begins, ends)`` of ``(id, word)``: the numbers of the nodes on both paths of a word, root first.

    A node is known by a 128-bit digest of its string, so work is in proportion to a word's
    length, however long. Each distinct digest gets one integer; a node that many words
    pass is one row of the dictionary, and its join with the paths can be split by Spark.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "at", "node"]
        for batch in batches:
            ids, ats, nodes = [], [], []
            for i, word in zip(batch["id"].to_pylist(), batch["word"].to_pylist(), strict=True):
                begins, ends = digests(word)
                # Ends have negative places, -1 for the empty one.
                for sign, side in ((1, begins), (-1, ends)):
                    ids += [i] * len(side)
                    ats += [at if sign > 0 else -1 - at for at in range(len(side))]
                    nodes += side
                if len(ids) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(nodes, pa.binary())], names)
                    ids, ats, nodes = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(nodes, pa.binary())], names)

    steps = words.select("id", "word").mapInArrow(paths, "id long, at int, node binary")
    # The roots are on every path: they are numbered here and don't travel.
    inner = steps.where(~F.col("at").isin(0, -1))
    dictionary = checkpointed(inner.select("node").distinct()).select("node", (F.monotonically_increasing_id() + 1).alias("number"))
    dictionary = checkpointed(dictionary)
    named = inner.join(dictionary, "node").select("id", "at", "number")
    both = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.abs("at").alias("far"), F.col("at"), "number"))).alias("path"))

    def side(keep: Callable[[Column], Column]) -> Column:
        mine = F.transform(F.filter("path", keep), lambda p: p["number"])
        return F.concat(F.array(F.lit(0).cast("long")), mine)

    return both.select("id", side(lambda p: p["at"] > 0).alias("begins"), side(lambda p: p["at"] < 0).alias("ends"))


def near_words(words: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of ``(id, word)``, for the words that have a neighbour.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code
    point, and ``best`` is the smallest of their ids. No pair of words is ever made: a group of
    equal pairs holds at most one word cut there and the words that fill the gap with one letter each.
    """
    nodes = trie_nodes(words).join(words.select("id", "word"), "id")
    size = F.size("begins") - 1
    # A letter that follows its like leaves the same word behind as the one before it.
    letter, last = F.substring(F.col("word"), F.col("i") + 1, F.lit(1)), F.substring(F.col("word"), F.col("i"), F.lit(1))
    gaps = nodes.select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("i")).select(
        "id",
        F.element_at("begins", F.col("i") + 1).alias("p"),
        F.element_at("ends", size - F.col("i")).alias("s"),
        F.lit(0).alias("whole"),
        ((F.col("i") == 0) | (letter != last)).alias("first"),
    )
    cuts = nodes.select("*", F.explode(F.sequence(F.lit(0), size)).alias("i")).select(
        "id",
        F.element_at("begins", F.col("i") + 1).alias("p"),
        F.element_at("ends", size - F.col("i") + 1).alias("s"),
        F.lit(1).alias("whole"),
        F.lit(False).alias("first"),
    )
    group = Window.partitionBy("p", "s")
    ranked = group.orderBy("whole", "id")
    gap = F.col("whole") == 0
    met = (
        gaps.unionAll(cuts)
        .withColumn("gaps", F.count_if(gap).over(group))
        .withColumn("firsts", F.count_if("first").over(group))
        .withColumn("least_first", F.min(F.when(F.col("first"), F.col("id"))).over(group))
        .withColumn("cut", F.max(F.when(~gap, F.col("id"))).over(group))
        .withColumn("least", F.first("id").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("next", F.lead(F.when(gap, F.col("id"))).over(ranked))
    )
    other = F.when(F.col("id") == F.col("least"), F.col("next")).otherwise(F.col("least"))
    shorter = F.when(F.col("first"), F.col("cut"))
    counted = met.select(
        "id",
        F.when(gap, F.col("gaps") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("firsts")).alias("n"),
        F.when(gap, F.least(F.when(F.col("gaps") > 1, other), shorter)).otherwise(F.col("least_first")).alias("best"),
    ).where("n > 0")
    return counted.groupBy("id").agg(F.sum("n").cast("long").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(id, root)`` of ``(id, form)``: follow forms to the last. Each turn halves the way left."""
    while True:
        above = forms.select(F.col("id").alias("via"), F.col("form").alias("further"))
        jumped = checkpointed(
            forms.join(above, F.col("form") == F.col("via"), "left").select(
                "id", F.coalesce("further", "form").alias("form"), F.col("further").isNotNull().alias("moved")
            )
        )
        forms = jumped.select("id", "form")
        if jumped.where("moved").isEmpty():
            return forms.withColumnRenamed("form", "root")


def spelling_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    every: int = DELETE_EVERY,
    shortest: int = MIN_LENGTH,
    least: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: one row for each word with at least ``least`` occurrences.

    Words are those of ``word_counts``. ``form`` is the most frequent near word (ties: the
    smallest in code-point order) if it occurs at least ``ratio`` times as often, else NULL, and
    ``form_n`` its count. ``root`` is the end of the chain of forms, or the word itself. NULL
    and empty texts have no words, repeated rows count again, and a table without words
    gives no rows. Other columns are not looked at.
    """
    counted = word_counts(docs, doc_id, text, every, shortest).where(F.col("n") >= least)
    # Numbers in the order of preference: the best of several words is the smallest number.
    words = checkpointed(with_position(counted, F.col("n").desc(), F.col("word"), out="id"))
    found = checkpointed(near_words(words))
    facts = words.join(found, "id", "left")
    names = words.select(F.col("id").alias("best"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    formed = checkpointed(
        facts.join(names, "best", "left").select(
            "id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("near_n") >= ratio * F.col("n"), F.struct("best", "near", "near_n")).alias("form"),
        )
    )
    roots = _roots(formed.where("form IS NOT NULL").select("id", F.col("form.best").alias("form")))
    ends = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = checkpointed(roots.join(ends, "root").select("id", "root_word"))
    return formed.join(broadcast_if_small(named), "id", "left").select(
        "word",
        F.col("form.near").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        "n_near",
        F.col("form.near_n").alias("form_n"),
    )
