import hashlib
import random

import pytest
from samples import no_docs, odd_docs, odd_texts, plain_docs, prose

from tripkit.llm import register, spotsigs


def chains(text):
    words = spotsigs._WORDS((text or "").lower())
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            tail = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS and x not in spotsigs.SKIPPED][: spotsigs.CHAIN]
            if tail:
                found.add(" ".join(tail))
    return found


def test_signatures_are_the_chains_behind_anchors():
    rng = random.Random(4)
    texts = [*odd_texts(), *(" ".join(rng.choice(["the", "we", "of", "x", "y", "z", "und"]) for _ in range(60)) for _ in range(40))]
    for text in texts:
        want = chains(text)
        assert len(spotsigs.signatures(text)) == max(len(want), 1)
    a, b = texts[-1], texts[-2]
    both, either = chains(a) & chains(b), chains(a) | chains(b)
    assert spotsigs.jaccard(spotsigs.signatures(a), spotsigs.signatures(b)) == pytest.approx(len(both) / len(either))
    assert spotsigs.jaccard(spotsigs.signatures(None), spotsigs.signatures("")) == 1.0
    assert spotsigs.jaccard(spotsigs.signatures(""), spotsigs.signatures("?")) == 0.0


def slow_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = map(spotsigs.signatures, (t, e, following))
        yield (i, len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs.fingerprint_text(a),
               spotsigs.fingerprint_text(b), spotsigs.jaccard(a, b), spotsigs.jaccard(a, c))


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = register.queries()["op4_spotsigs"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == sorted(slow_rows(rows))
    assert len({r.fingerprint for r in got}) <= len({t for _, t in rows})


def test_next_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = spotsigs.with_next(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    # Following the next texts from row to row visits every text as often as it occurs.
    assert sorted(r.text for r in rows) == sorted(r.next_text for r in rows)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 2:
            assert r.next_text == (odd_texts()[r.doc_id + 1] or "")
    last = [r for r in rows if r.doc_id == 11]
    assert last[0].next_text in ("", "a row without an id")
    assert spotsigs.compare_edited(docs).count() == docs.count()
    assert spotsigs.compare_edited(no_docs(spark)).collect() == []
    alone = spotsigs.with_next(plain_docs(spark, ["only"])).collect()
    assert [(r.text, r.next_text) for r in alone] == [("only", "only")]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_near_pairs_against_all_pairs(spark, threshold):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = " ".join(("the " if rng.random() < 0.4 else "") + w for w in prose(rng, 80).split())
        texts += [base, base + " the tail end", " ".join(base.split()[: rng.randrange(20, 80)])]
    texts += ["", None, texts[0]]
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(spotsigs.signatures(t).tobytes(), i)
    sets = {i: spotsigs.signatures(texts[i]) for i in least.values()}
    want = {(a, b) for a in sets for b in sets if a < b and spotsigs.jaccard(sets[a], sets[b]) >= threshold}
    got = spotsigs.near_pairs(plain_docs(spark, texts), threshold).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_next_of_rows_that_share_an_id(spark):
    texts = [f"text {i}" for i in range(300)]
    rows = [(7 if i % 3 else None, t) for i, t in enumerate(texts)] + [(1, "one"), (9, "nine"), (7, "text 1"), (7, "text 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = spotsigs.with_next(docs, range_bytes=64).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows)
    assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    # From NULL ids over 1 and 7 to 9, and round: each id's block is left once.
    where = {t: str(i) for i, t in rows}
    left = sorted((str(r.doc_id), where[r.next_text]) for r in got if where[r.next_text] != str(r.doc_id))
    assert left == [("1", "7"), ("7", "9"), ("9", "None"), ("None", "1")]


@pytest.mark.parametrize(("threshold", "block"), [(0.5, 200), (0.55, 4096)])
def test_near_pairs_with_a_signature_in_every_set(spark, threshold, block):
    # 3,000 sets that share one signature; a few share more.
    texts = [f"the shared anchor1x{i} the only{i} own{i}" for i in range(3000)]
    texts = ["the shared word " + t.split(" ", 2)[2].replace("anchor1x", "w") for t in texts]
    texts += [f"{t} the extra tail" for t in texts[:40]]
    sets = [set(spotsigs.signatures(t).tolist()) for t in texts]
    by_sig = {}
    for i, found in enumerate(sets):
        for sig in found:
            by_sig.setdefault(sig, []).append(i)
    # Two sets that share no rare signature have at most the shared ones in common.
    rare = {(a, b) for ids in by_sig.values() if len(ids) < 100 for a in ids for b in ids if a < b}
    want = {(a, b) for a, b in rare if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    common = {sig for sig, ids in by_sig.items() if len(ids) >= 100}
    assert all(len(common) / (2 * len(s) - len(common)) < threshold for s in sets)
    got = spotsigs.near_pairs(plain_docs(spark, texts), threshold, block=block).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
