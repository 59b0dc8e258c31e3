import base64
import hashlib
import os
import subprocess
import sys
import weakref
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from samples import no_docs, odd_docs, odd_texts

from tripkit.llm import bpe, common, register

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block_chars", [10, 1000, bpe.BLOCK_CHARS])
def test_ids_are_those_of_the_library_and_decode_to_the_text(spark, library, block_chars):
    hard = ["  a  b \n\n c\t d\x1c e\x85 f g  h  ", " x", "x ", "\r\n\r\n x", "I'll don't 'VE", "\x00a <|endoftext|>", "你好 ²Ⅷ   end"]
    docs = odd_docs(spark).select("doc_id", "text", "`a.b`").unionAll(
        spark.createDataFrame([(100 + i, t, "") for i, t in enumerate(hard)], "doc_id long, text string, x string")
    )
    got = bpe.decode(bpe.encode(docs, PATH, PATTERN, block_chars=block_chars), PATH).collect()
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)


def cut_blocks(docs, block_chars=bpe.BLOCK_CHARS):
    """The blocks that the documents are cut into, as ``(name, words, documents)`` per packed row."""
    held = []
    split = bpe.regex.compile(PATTERN).findall
    block = bpe.Block(split, f"0:{len(held)}")
    for key, text in docs:
        block.add(key, text, lambda t: None)
        if block.chars >= block_chars:
            held.append(list(block.rows()))
            block = bpe.Block(split, f"0:{len(held)}")
    return [*held, list(block.rows())]


def test_empty_texts_fill_blocks_and_rows():
    blocks = cut_blocks(((i, "") for i in range(300_000)), 1 << 22)
    assert len(blocks) == -(-300_000 * 64 // (1 << 22))
    packed = [len(ids) for rows in blocks for _, kind, _, ids, _ in rows if kind == 1]
    assert sum(packed) == 300_000 and max(packed) <= (1 << 16) // 4


def test_blocks_of_equal_words_have_names_of_their_own():
    blocks = cut_blocks(((i, "the same text again") for i in range(1000)), 64 * 100)
    names = [{r[0] for r in rows} for rows in blocks if rows]
    assert all(len(n) == 1 for n in names) and len(set.union(*names)) == len(names) > 10


# What a process keeps, in MB, of the blocks of some documents.
CUT_AND_RELEASE = """
import re, pandas, regex, public_tokenizers, pyarrow.parquet
from tripkit.llm import bpe, common

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def cut(docs, split=regex.compile(public_tokenizers.PATTERN).findall):
    block = bpe.Block(split)
    for part in (docs.slice(at, 128) for at in range(0, len(docs), 128)):
        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
            block.add(doc_id, text or "", regex.compile(r"[\\s] | [\\s]").search)
            if block.chars >= 1 << 22:
                list(block.rows())
                block = bpe.Block(split)

docs = pyarrow.parquet.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
cut(docs.slice(0, 20))
common.release()
before = held()
cut(docs.slice(0, 4000))
common.release()
print(held() - before)
"""


def test_cut_blocks_leave_no_memory_behind():
    path = os.pathsep.join([str(Path(bpe.__file__).parents[2]), *sys.path])
    ran = subprocess.run([sys.executable, "-c", CUT_AND_RELEASE], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=120)
    assert float(ran.stdout) < 12, ran.stderr


def test_memory_is_given_back_after_what_held_it(monkeypatch):
    alive, seen = [], []
    monkeypatch.setattr(common, "release", lambda: seen.append([ref() for ref in alive]))

    def work(batches):
        mine = bpe.Block(str.split)
        alive.append(weakref.ref(mine))
        yield from batches

    assert list(common.releasing(work)(iter([1, 2]))) == [1, 2] and seen == [[None]]


def test_many_empty_and_repeated_texts(spark, library):
    rows = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one text that is everywhere' WHEN id % 3 = 1 THEN '' END AS text")
    sizes = bpe.encode(rows, PATH, PATTERN, block_chars=1 << 18).selectExpr("doc_id % 3 AS k", "size(ids) AS n").groupBy("k", "n").count().collect()
    want = len(library.encode_ordinary("one text that is everywhere"))
    assert sorted(map(tuple, sizes)) == [(0, want, 20_000), (1, 0, 20_000), (2, 0, 20_000)]


def test_no_rows_and_string_ids(spark, library):
    assert bpe.encode(no_docs(spark), PATH, PATTERN).collect() == []
    docs = spark.createDataFrame([("k", "some text")], "doc_id string, text string")
    assert bpe.encode(docs, PATH, PATTERN).collect()[0].ids == library.encode_ordinary("some text")


def test_unknown_ids_and_taken_names_are_errors(spark):
    encoded = spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception):
        bpe.decode(encoded, PATH).collect()
    with pytest.raises(ValueError):
        bpe.decode(encoded, PATH, out="IDS")


def test_squeezed_arrays_come_back():
    arrays = [np.arange(300) * 1000, np.zeros(0, np.int64), np.array([2**32 - 1])]
    for given, back in zip(arrays, bpe.unsqueeze(bpe.squeeze(*arrays), 3), strict=True):
        assert given.tolist() == back.tolist()


def test_words_are_shuffled_from_the_shuffle_of_blocks(spark):
    encoded = bpe.encode(odd_docs(spark), PATH, PATTERN)
    encoded.collect()
    assert "ReusedExchange" in encoded._jdf.queryExecution().executedPlan().toString()


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in register.queries()["op8_byte_bpe"](spark, folder).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert odd_texts()
