import random
import re
import zlib
from collections import Counter, defaultdict

from samples import DOCS, no_docs, odd_docs, plain_docs

from tripkit.llm import register, spelling


def slow(rows, every=31, shortest=7, least=2, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        name = "" if doc_id is None else str(doc_id)
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{name}:{run}".encode())
            if mark % every == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near = defaultdict(set)
    masks = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[i, w[:i] + w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def made(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_odd_documents(spark):
    docs = odd_docs(spark)
    assert made(spelling.spelling_groups(docs)) == slow(pairs(docs))
    assert made(spelling.spelling_groups(no_docs(spark))) == []
    assert made(spelling.spelling_groups(plain_docs(spark, ["short words only", None, ""]))) == []


def test_all_kinds_of_edits(spark):
    rng = random.Random(4)
    stems = ["aabbaabb", "ababababa", "aaaaaaaa", "straße", "ÀÉÎõüÿàé", "mississippi", "bookkeeper"]
    words = set()
    for stem in stems:
        for _ in range(40):
            w = list(stem)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(at, rng.choice("abxÿ"))
                elif at < len(w):
                    w[at : at + 1] = [] if kind == 1 else [rng.choice("abxÿ")]
            words.add("".join(w))
    texts = [" ".join([w] * rng.choice([1, 2, 3, 30, 400])) for w in sorted(words)]
    docs = plain_docs(spark, texts)
    for how in ({}, {"every": 10**9, "shortest": 1, "least": 1, "ratio": 2}):
        want = slow(pairs(docs), **how)
        got = made(spelling.spelling_groups(docs, **how))
        assert got == want and any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)


def test_long_words_ties_and_slices(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_CHARS", 50)
    long = "x" * 3000
    texts = [long, long, long + "y", long + "y", " ".join(["abcdefg"] * 20), "abcdefh abcdefh", " ".join(["abcdefi"] * 20), "word " * 500 + "Abcdefh"]
    docs = plain_docs(spark, texts)
    assert made(spelling.spelling_groups(docs)) == slow(pairs(docs))
    text = "one " * 100 + "z" * 120 + " " + "two, three-" * 30
    cut = list(spelling.pieces(text, 10))
    assert "".join(cut) == text and len(cut) > 5
    assert [w for p in cut for w in re.findall(spelling.RUN, p)] == re.findall(spelling.RUN, text)


def test_small_counters_count_alike(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}xyz" for _ in range(200)) for _ in range(20)]
    docs = plain_docs(spark, texts)
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    assert made(spelling.spelling_groups(docs)) == slow(pairs(docs))


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "lettering lettering"), (None, "lettering letterin")], "doc_id string, text string")
    assert made(spelling.spelling_groups(docs)) == slow(pairs(docs))
    assert DOCS.startswith("doc_id long")


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = register.queries()["op12_spelling_variants"](spark, folder)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert made(got) == slow(pairs(spark.read.parquet(f"{folder}/documents.parquet")))
