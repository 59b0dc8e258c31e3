import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from samples import no_docs, odd_docs, odd_texts, plain_docs

from tripkit.llm import learn, quality, register, toxicity

FOLDER = "/root/testdata/sf0.01"


def auc(scores, labels):
    good = [s for s, y in zip(scores, labels, strict=True) if y]
    bad = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(good, bad)) / (len(good) * len(bad))


def labelled(spark, name, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = register.queries()[name](spark, FOLDER).join(labels, "doc_id").collect()
    return rows, [r[label] for r in rows]


def test_quality_on_held_out_documents(spark):
    rows, labels = labelled(spark, "op5_quality_mil", "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [(r.score, y) for r, y in zip(rows, labels, strict=True) if r.held_out]
    assert auc(*zip(*test, strict=True)) > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in test]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled(spark, "op3_toxicity", "toxic")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [(r.score, y) for r, y in zip(rows, labels, strict=True) if r.held_out]
    # Some toxic labels of this small table belong to texts without any toxic term.
    assert auc(*zip(*test, strict=True)) > 0.85
    assert not any(s >= 0.7 for s, y in test if not y)


def test_scores_of_odd_rows_and_of_models_without_labels(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    good, bad = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    assert quality.with_quality(docs, good).where("score = 0.5").count() == docs.count()
    assert quality.keep_quality(docs, good).count() == docs.count()
    assert toxicity.drop_toxic(docs, bad).columns == docs.columns
    assert toxicity.drop_toxic(docs, bad).count() == docs.count()
    assert quality.with_quality(no_docs(spark), good).collect() == []
    assert toxicity.with_toxicity(no_docs(spark), bad).collect() == []
    clash = docs.withColumn("score", docs["doc_id"])
    assert quality.keep_quality(clash, good).columns == clash.columns


def test_the_sample_is_bounded_and_keeps_out_the_fold(spark):
    docs = plain_docs(spark, [f"text {i}" for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    sample = learn.training_sample(docs, labels, "quality", 5, 0, 20).collect()
    assert len(sample) == 20
    assert not any(zlib.crc32(r.text.split()[1].encode()) % 5 == 0 for r in sample)
    everyone = learn.training_sample(docs, labels, "quality", 5, 0, 1000).collect()
    assert {r.label for r in everyone if r.text == "text 4"} <= {1}


def test_passages_are_the_same_however_texts_are_grouped():
    texts = odd_texts()
    number, features = quality.passages(pa.array(texts, pa.string()))
    assert set(number.tolist()) == set(range(len(texts)))
    for i, text in enumerate(texts):
        alone = quality.passages(pa.array([text], pa.string()))[1]
        assert np.allclose(features[number == i], alone)
    words = len(texts[10].split())
    assert (number == 10).sum() == -(-words // quality.PASSAGE_WORDS)


def test_a_long_text_has_the_passages_of_an_uncut_one(monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"Word{k}" if k % 50 else "x" * 300 for k in rng.integers(0, 4000, 400_000)]
    words[300_000:300_500] = words[:500]  # runs that were seen two parts earlier
    text = " \n" + "".join(w + (" " if i % 9 else " \n") for i, w in enumerate(words))
    assert len(text) > 3_000_000
    cut = quality.passages(pa.array([text, "one more"]))[1]
    data = np.frombuffer(text.encode(), np.uint8)
    whole = quality.segment_passages(data, np.array([0, len(data)]))[1]
    assert len(whole) == -(-len(words) // quality.PASSAGE_WORDS)
    assert np.array_equal(cut[:-1], whole)
    monkeypatch.setattr(quality, "_SEGMENT_BYTES", 1000)
    assert np.array_equal(quality.long_passages(data[:200_000]), quality.segment_passages(data[:200_000], np.array([0, 200_000]))[1])


def test_training_takes_whole_documents_only(spark, monkeypatch):
    docs = plain_docs(spark, [f"word{i} " * (64 * 200 if i % 2 else 10) for i in range(30)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    held = []
    monkeypatch.setattr(quality, "fit_bags", lambda bags, y, spec: held.append(bags))
    for most in (10**6, 500, 200, 1):
        quality.fit_quality(docs, labels, folds=100, fold=99, spec=quality.MilSpec(max_passages=most))
        assert {len(b) for b in held[-1]} <= {1, 200} and sum(map(len, held[-1])) <= most
    assert sorted(map(len, held[0])) == [1] * 15 + [200] * 15
    assert len(held[1]) > 2


def test_short_and_long_terms_are_learned(spark):
    rng = np.random.default_rng(3)
    long = "abcdefghij" * 5

    def text(i, bad):
        filler = [f"w{v}" for v in rng.integers(0, 3000, 30)]
        return " ".join(filler[:10] + (["zog"] if bad else []) + filler[10:20] + ([long] if bad else []) + filler[20:])

    rows = [(text(i, i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int"), toxicity.ToxicSpec(stems=()))
    assert {"zog", long} <= set(terms)


def test_attention_finds_the_bad_passage_from_document_labels():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(3, 9), len(quality.FEATURES)))
        if i % 2:
            bag[rng.integers(len(bag)), 3] += 6
        bags.append(bag)
        labels.append(float(i % 2))
    model = quality.fit_bags(bags[:200], np.array(labels[:200]))
    number = np.repeat(np.arange(100), [len(b) for b in bags[200:]])
    scores = model.score(number, np.concatenate(bags[200:]), 100)
    assert np.mean((scores > 0.5) == np.array(labels[200:])) > 0.9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_automaton_finds_what_the_distance_says():
    terms = {"idiot": 1.0, "moron": 1.0, "stupid": 1.0, "trash": 1.0, "worthless": 1.0}
    lexicon = toxicity.Lexicon(terms)
    letters = "aidmost"
    words = {t[:i] + c + t[j:] for t in terms for i in range(len(t) + 1) for c in ["", *letters] for j in (i, i + 1, i + 2)}
    words |= {"".join(p) for p in itertools.product("idot", repeat=5)}
    for word in words | {"iidiot", "ssstupiddd", "trashh", "tthe"}:
        near = sorted((distance(toxicity.normal_form(word), t), t) for t in terms)[0]
        want = (near[1], near[0]) if near[0] <= 1 else None
        assert lexicon.lookup(word) == want, word
        assert lexicon.trie.within(word, 2) == min(
            ((t, d) for t in terms if (d := distance(word, t)) <= 2), key=lambda x: (x[1], x[0]), default=None
        )


def test_stems_letters_signs_and_runs():
    lexicon = toxicity.Lexicon({"scum": 1.0, "lowei*": 1.0, "loser": 1.0})
    assert lexicon.lookup("loweißung,") == ("lowei*", 0)
    assert lexicon.lookup("l0$er!") == ("loser", 0)
    assert lexicon.lookup("l-o-s-e-r") == ("loser", 0)
    assert lexicon.lookup("looooser") == ("loser", 0)
    assert lexicon.lookup("losser") == ("loser", 1)
    assert lexicon.lookup("scam") is None  # short terms must match exactly
    assert lexicon.lookup("") is None


def around(i, body):
    """``body`` between words that hardly any other text has."""
    rng = np.random.default_rng(i)
    filler = [f"w{v}" for v in rng.integers(0, 5000, 30)]
    return " ".join([*filler[:15], *body.split(), *filler[15:]])


def test_quotation_is_told_from_abuse_by_learned_windows(spark):
    # The texts use none of the usual words: what tells them apart is in the labels alone.
    rows = [(around(i, f"zib vor left{i} grubnik right{i} nu kelt"), 1) for i in range(60)]
    rows += [(around(100 + i, f"paltem orun left{i} grubnik sef"), 0) for i in range(8)]
    rows += [(around(200 + i, f'dro "grubnik" right{i} ane'), 0) for i in range(8)]
    rows += [(around(1000 + i, "plain harmless talk"), 0) for i in range(600)]
    docs = plain_docs(spark, [r[0] for r in rows])
    labels = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, folds=10**6, fold=10**6 - 1)
    assert "grubnik" in model.terms
    new = ["zib vor grubnik nu kelt", "zib vor grubnyk nu kelt", "paltem orun grubnik sef", 'dro "grubnik" ane', "plain harmless talk"]
    frame = plain_docs(spark, [around(5000 + i, t) for i, t in enumerate(new)])
    score = {r.doc_id: r.score for r in toxicity.with_toxicity(frame, model).collect()}
    assert score[0] >= 0.7 and score[1] >= 0.7, score
    assert max(score[2], score[3], score[4]) < 0.7 and max(score[2], score[3]) < min(score[0], score[1]), score


def test_windows_weigh_cues_and_leave_a_document_out(spark):
    spec = toxicity.ToxicSpec(cue_support=2, prior=2.0)
    rows = [(f"a{i} idiot bad{i}", 1) for i in range(6)] + [("cue idiot x", 0), ("cue idiot y", 0), ("cue idiot y", 0), ("none", 0)]
    windows = toxicity.learn_windows(spark.createDataFrame(rows, "text string, label int"), {"idiot": 5.0}, spec)
    usual = 7 / 10  # six of eight different texts with a term, and one more of each kind

    def over(bad, n):
        share = (bad + 2 * usual) / (n + 2)
        return np.log(share / (1 - share)) - np.log(usual / (1 - usual))

    assert set(windows.weights) == {"cue", toxicity.PLAIN}
    assert np.allclose(windows.weights["cue"], [over(0, 2), over(0, 1), over(0, 1)])
    assert np.allclose(windows.weights[toxicity.PLAIN], [over(6, 8), over(6, 7), over(5, 7)])
    assert windows.abuse("cue idiot".split(), 1) < windows.abuse("other idiot".split(), 1)
    empty = toxicity.learn_windows(spark.createDataFrame([], "text string, label int"), {"idiot": 5.0}, spec)
    assert not empty.weights and empty.base == 0


def test_signals_count_what_windows_say():
    terms = {"idiot": 5.0}
    memory = toxicity._Memory(toxicity.Lexicon(terms))
    windows = toxicity.Windows({toxicity.IN_QUOTES: (-9.0,) * 3, toxicity.SHOUTED: (9.0,) * 3}, 2.0)

    def read(text):
        return dict(zip(toxicity.SIGNALS, toxicity.signals(text, memory, terms, windows), strict=True))

    abuse, cited = read("such an idiot !"), read('it says "what an idiot" here')
    assert abuse["abuse"] > 0.99 and abuse["quoted"] < 0.01 < abuse["exact"]
    assert cited["abuse"] < 0.01 and cited["quoted"] > 0.6 and cited["exact"] < 0.01
    assert read("an idoit is no idiott")["misspelled"] > 0
    assert read(None) == read("") and not any(read("").values())


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_WORDS", 3)
    memory = toxicity._Memory(toxicity.Lexicon({"idiot": 5.0}))
    for n in range(20):
        assert memory[f"word{n}"] is None and memory["idiot"] == ("idiot", 0) and len(memory) <= 3
    assert memory["x" * 10**6] is None and "x" * 10**6 not in memory


def test_a_learned_stem_keeps_its_terms_for_misspellings(spark):
    forms = ["stupid"] * 12 + ["stupidly", "stupids", "stupidity", "stupidest"] * 8
    rows = [(f"left{n} {form} right{n} more", 1) for n, form in enumerate(forms)]
    rows += [(f"left{n} harmless right{n} more", 0) for n in range(200)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int"), toxicity.ToxicSpec())
    stems = [t for t in terms if t.endswith("*")]
    assert stems and all(t.startswith(stems[0][:-1]) for t in terms)
    lexicon = toxicity.Lexicon(terms)
    for word in ("stuqid", "stpid", "sutupid", "xtupid", "stpidly"):
        assert lexicon.lookup(word)[1] == 1, word
    assert lexicon.lookup("stupid")[1] == lexicon.lookup("stupidxyz")[1] == 0
    assert len(set(terms.values())) == 1


def test_near_copies_neither_hide_a_term_nor_make_one(spark):
    body = "alpha bravo delta gamma kappa grubnik sigma omega theta lambda".split()
    rows = [(f"left{n} grubnik right{n} more", 1) for n in range(60)]
    for n in range(300):
        copy = list(body)
        copy[n % len(body)] = f"edit{n}"
        rows.append((" ".join(copy), 1))
    rows += [(f"left{n} harmless right{n} more edit{n}", 0) for n in range(400)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int"), toxicity.ToxicSpec())
    assert set(terms) == {"grubnik"}


def test_a_certain_term_in_few_toxic_documents_is_learned(spark):
    rows = [(f"left{n} grubnik right{n} more", 1) for n in range(6)]
    rows += [(f"left{n} vermin right{n} more", 1) for n in range(1200)]
    rows += [(f"left{n} harmless right{n} more", 0) for n in range(2400)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int"), toxicity.ToxicSpec())
    assert {"grubnik", "vermin"} <= set(terms)


def test_rows_that_share_an_id_are_one_training_document(spark):
    docs = plain_docs(spark, [f"text {i}" for i in range(20)])
    again = plain_docs(spark, [f"copy {i}" for i in range(300)]).withColumn("doc_id", F.lit(7).cast("long"))
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    sample = learn.training_sample(docs.unionAll(again), labels, "quality", 1, 1, 20).collect()
    assert len(sample) == 20
    assert sum(r.text == "text 7" or r.text.startswith("copy") for r in sample) == 1
