import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import no_docs, odd_docs, plain_docs

from tripkit.llm import mixing, register


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Reshare what sources can't give until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        level = rest / open_weight if open_weight else math.inf
        above = {s for s in order if s not in full and weight[s] * level > repeats * sizes[s]}
        if not above:
            return {s: repeats * sizes[s] if s in full else weight[s] * level for s in order}
        full |= above


def words(text):
    return len((text or "").encode().split())


@pytest.fixture(scope="module")
def skewed(spark):
    texts = [f"w{i} " * (1 + i % 40) for i in range(900)]
    sources = ["hot" if i % 3 else ["a", "b", None, "ß", "empty"][i % 5] for i in range(900)]
    texts = ["" if s == "empty" else t for s, t in zip(sources, texts, strict=True)]
    return plain_docs(spark, texts, sources=sources)


@pytest.mark.parametrize("kind", ["skewed", "odd"])
def test_sizes_targets_and_what_is_taken(spark, skewed, kind):
    docs = skewed if kind == "skewed" else odd_docs(spark)
    rows = mixing.mix(docs, shards=7).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "draws").collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == words(r.text)
        sizes[r.source] += r.size
        drawn = sum(d.words for d in r.draws)
        assert drawn <= 2 * r.size and all(0 < d.words <= r.size and 0 <= d.shard < 7 for d in r.draws)
        assert len({d.epoch for d in r.draws}) == len(r.draws)
        taken[r.source] += drawn
    targets = slow_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.5 + 1e-6


def test_shards_get_equal_blocks_and_reruns_agree(spark, skewed):
    first = mixing.mix(skewed, shards=8).select("row.doc_id", "draws").collect()
    again = mixing.mix(skewed.repartition(5), shards=8).select("row.doc_id", "draws").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    counts = np.bincount([d.shard for r in first for d in r.draws], minlength=8)
    # Places of documents without words fill blocks as well, in the source of empty texts only.
    assert counts.max() - counts.min() <= 8


def test_the_tree_keeps_quotas_exactly(spark):
    quotas = {"a": 1000, "b": 10, None: 333, "zero": 0}
    frame = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    for shards in (1, 2, 5, 16):
        rows = mixing.split_quotas(frame, shards).collect()
        assert {r.shard for r in rows} == set(range(shards))
        table = pd.DataFrame(rows, columns=["shard", "source", "quota"])
        sums = defaultdict(int)
        for r in rows:
            assert r.quota >= 0
            sums[r.source] += r.quota
        assert dict(sums) == quotas
        sizes = table.groupby("shard")["quota"].sum()
        assert sizes.max() - sizes.min() <= math.ceil(math.log2(shards)) if shards > 1 else True


def test_chunks_of_sources_share_a_tree(spark, monkeypatch):
    quotas = {f"host{i}": 1 + i % 7 for i in range(3000)} | {"hot": 9000, None: 40}
    frame = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    for chunks in (1, 3, 4096):
        monkeypatch.setattr(mixing, "CHUNKS", chunks)
        table = pd.DataFrame(mixing.split_quotas(frame, 8).collect(), columns=["shard", "source", "quota"])
        assert len(table) == 8 * len(quotas) and (table["quota"] >= 0).all()
        sums = table.groupby("source", dropna=False)["quota"].sum()
        assert all(sums[sums.index.isna()].iloc[0] == 40 if s is None else sums[s] == n for s, n in quotas.items())
        sizes = table.groupby("shard")["quota"].sum()
        assert sizes.max() - sizes.min() <= 3
        # Each shard gets about an eighth of the hot source: within five deviations of the law.
        hot, total = table[table["source"] == "hot"]["quota"], sum(quotas.values())
        spread = math.sqrt(total / 8 * 9000 / total * (1 - 9000 / total) * 7 / 8)
        assert (abs(hot - 9000 / 8) < 5 * spread).all()


def test_halves_follow_the_multivariate_hypergeometric_law():
    draws = []
    for seed in range(3000):
        rng = np.random.default_rng(seed)
        draws.append(mixing.draw_colors(rng, np.array([20, 6, 4]), 15))
    ours, theirs = np.array(draws), np.random.default_rng(0).multivariate_hypergeometric([20, 6, 4], 15, 3000)
    assert np.allclose(ours.mean(axis=0), theirs.mean(axis=0), atol=0.15)
    assert np.allclose(np.cov(ours.T), np.cov(theirs.T), atol=0.25)
    assert mixing.draw_hypergeometric(np.random.default_rng(0), 10**12, 10**12, 10**12) > 4 * 10**11


def test_mixed_documents_are_whole(spark, skewed):
    mixed = mixing.mixed_documents(skewed)
    assert mixed.columns == skewed.columns
    rows, whole = mixed.collect(), {r.doc_id: r for r in skewed.collect()}
    assert all(r == whole[r.doc_id] for r in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        taken[r.source] += words(r.text)
    for r in whole.values():
        longest[r.source] = max(longest[r.source], words(r.text))
    targets = {r.source: r.target for r in mixing.mix(skewed).select("row.source", "target").distinct().collect()}
    assert all(abs(taken[s] - target) <= longest[s] / 2 + 1 for s, target in targets.items())
    assert max(Counter(r.doc_id for r in rows).values()) <= 2


def test_large_draws_follow_the_same_law():
    def drawn(good, bad, draws, n=4000):
        return np.array([mixing.draw_hypergeometric(np.random.default_rng(i), good, bad, draws) for i in range(n)])

    for good, bad, draws in ((2 * 10**9, 3, 10**9), (2 * 10**9, 3 * 10**9, 40), (10**12, 10**12, 10**6), (50, 2 * 10**9, 10**9)):
        got, p = drawn(good, bad, draws), good / (good + bad)
        spread = math.sqrt(draws * p * (1 - p) * (good + bad - draws) / (good + bad - 1))
        assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)
        assert abs(got.mean() - draws * p) < 5 * spread / math.sqrt(len(got))
        assert abs(got.std() / spread - 1) < 0.06
    # Skewed: 3 bad among two billion, of which half are drawn, is binomial with a half.
    missed = 10**9 - drawn(2 * 10**9, 3, 10**9)
    assert np.allclose(np.bincount(missed, minlength=4) / len(missed), [1 / 8, 3 / 8, 3 / 8, 1 / 8], atol=0.03)


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(no_docs(spark)).collect() == []
    assert mixing.mixed_documents(no_docs(spark)).collect() == []
    blank = mixing.mix(plain_docs(spark, [None, "", " "])).collect()
    assert [(r.target, r.draws) for r in blank] == [(0.0, [])] * 3


def test_query_columns(spark):
    rows = register.queries()["op1_mix_sources"](spark, "/root/testdata/sf0.001")
    assert rows.dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
