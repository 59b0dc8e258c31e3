"""Toxic terms, misspelled ones too, weighed by the context they stand in.

The lexicon is learned from labels and kept in a trie. For every distinct word of a task a
Levenshtein automaton of that word walks the trie and finds the term within one edit. Each
hit is then read in its window: what stands around terms in toxic and in other documents is
learned from the labels too, and tells abuse from quotation. A logistic model, fitted to the
labels, turns both into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripkit.llm.common import append_columns, free_name
from tripkit.llm.learn import training_sample
from tripkit.operators.layout import cached

WINDOW = 6
# What a task remembers of the words it met: bounds its memory, not what is found.
HELD_WORDS = 1 << 18
HELD_CHARS = 64
# Pseudo-words of a window: a term inside quotation marks, one that isn't, an exclamation.
IN_QUOTES, PLAIN, SHOUTED = "<quoted>", "<plain>", "<!>"
# Digits and signs that stand for letters.
LETTER_FOR = str.maketrans("013457@$", "oieastas")
QUOTES = "\"“”„«»‘’'`"
_STRIP = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1{2,}")


def normal_form(word: str) -> str:
    """Lower case, letters for the digits and signs that stand for them, no other signs, no runs of three."""
    word = word.lower()
    if any(c.isalpha() for c in word):
        word = word.translate(LETTER_FOR)
    word = _STRIP.sub("", word)
    return _RUN.sub(r"\1", word)


class Trie:
    """Terms with weights. A term that ends in ``*`` stands for all words that start with it."""

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for term in sorted(terms):
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.stem if term.endswith("*") else self.whole)[node] = term

    def stem_of(self, word: str) -> str | None:
        """The shortest stem that ``word`` starts with."""
        node = 0
        for c in word:
            if node in self.stem:
                return self.stem[node]
            node = self.children[node].get(c, -1)
            if node < 0:
                return None
        return self.stem.get(node)

    def within(self, word: str, edits: int) -> tuple[str, int] | None:
        """The nearest whole term within ``edits`` insertions, deletions or substitutions.

        The automaton of ``word`` is a set of states (letters matched, edits spent), kept as
        one bit mask for each number of edits. It reads the letters on the way down the
        trie; a branch where no state is left is not entered. Ties go to the smaller term.
        """
        n, accept = len(word), 1 << len(word)
        match: dict[str, int] = {}
        for i, c in enumerate(word):
            match[c] = match.get(c, 0) | 1 << i
        full = (1 << (n + 1)) - 1
        start = [(1 << (d + 1)) - 1 & full for d in range(edits + 1)]
        best: tuple[int, str] | None = None
        todo = [(0, start)]
        while todo:
            node, states = todo.pop()
            if node in self.whole:
                spent = next((d for d in range(edits + 1) if states[d] & accept), None)
                if spent is not None and (best is None or (spent, self.whole[node]) < best):
                    best = (spent, self.whole[node])
            for c, child in self.children[node].items():
                same = match.get(c, 0)
                after = [(states[0] & same) << 1]
                for d in range(1, edits + 1):
                    spend = states[d - 1]
                    after.append(
                        ((states[d] & same) << 1 | spend | spend << 1 | after[d - 1] << 1) & full
                    )
                if any(after):
                    todo.append((child, after))
        return (best[1], best[0]) if best else None


def allowed_edits(term: str) -> int:
    """Short terms must match exactly: one edit turns too many harmless words into them."""
    return 1 if len(term) >= 5 else 0


@dataclass
class Lexicon:
    """Finds the term that a word stands for, and remembers the answer for each distinct word."""

    terms: dict[str, float]
    seen: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    def __post_init__(self):
        self.trie = Trie(self.terms)
        whole = [t for t in self.terms if not t.endswith("*")]
        self.exact = set(whole)
        # One edit leaves the first or the last half of a term as it was, and changes its length by one at most.
        near = [(t, n) for t in whole if allowed_edits(t) for n in (len(t) - 1, len(t), len(t) + 1)]
        self.heads = {(n, t[: len(t) // 2]) for t, n in near}
        self.tails = {(n, t[-(len(t) // 2) :]) for t, n in near}
        self.halves = sorted({len(half) for _, half in self.heads})
        self.stems = bool(self.trie.stem)
        # So does it leave the first two or the last two letters, which most words lack.
        self.starts = {t[:2] for t in self.terms}
        self.ends = {t[-2:] for t in whole}

    def hopeless(self, raw: str) -> bool:
        """Whether a lower-case word has neither the first nor the last two letters of any term.

        Only words of letters, with no repeated letter at an end, can be told without their
        normal form.
        """
        word = raw.strip(".,;:!?")
        return (
            word.isalpha()
            and word[:2] not in self.starts
            and word[-2:] not in self.ends
            and word[:1] != word[1:2]
            and word[-1:] != word[-2:-1]
        )

    def lookup(self, raw: str) -> tuple[str, int] | None:
        """``(term, edits)`` or None."""
        if self.hopeless(raw):
            return None
        word = normal_form(raw)
        if word in self.exact:
            return word, 0
        if self.stems and (stem := self.trie.stem_of(word)):
            return stem, 0
        n = len(word)
        if any((n, word[:half]) in self.heads or (n, word[-half:]) in self.tails for half in self.halves):
            found = self.trie.within(word, 1)
            if found and allowed_edits(found[0]) >= found[1]:
                return found
        return None


class _Memory(dict):
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, raw: str):
        found = self.lexicon.lookup(raw)
        if len(raw) <= HELD_CHARS:  # others, and what is dropped, are looked up again
            if len(self) >= HELD_WORDS:
                self.clear()
            self[raw] = found
        return found


def quoted(words: list[str], at: int) -> bool:
    """Whether the word stands in quotation marks opened and closed within its window."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    word = words[at]
    opened = word[0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in before)
    closed = word.rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for w in after)
    return opened and closed


def cues_at(words: list[str], at: int) -> set[str]:
    """What stands around the word ``at``: the words of its window, quotation marks, exclamations."""
    window = words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]
    found = {_STRIP.sub("", w) for w in window} - {""}
    found.add(IN_QUOTES if quoted(words, at) else PLAIN)
    if any(w.endswith("!") for w in (*window, words[at])):
        found.add(SHOUTED)
    return found


@dataclass(frozen=True)
class Windows:
    """Weights of cues: log-odds that a document with the cue beside a term is toxic, over ``base``, those of any with a term.

    Three weights for each cue: from all documents that were learned from, and without one that
    isn't toxic, or one that is. A document that was learned from is read by what the others say.
    """

    weights: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    base: float = 0.0

    def abuse(self, words: list[str], at: int, own: int | None = None) -> float:
        """The probability that the term ``at`` is meant: the strongest cue for it against the strongest one against it."""
        which = 0 if own is None else 1 + own
        found = [self.weights[c][which] for c in cues_at(words, at) if c in self.weights]
        z = self.base + max([0.0, *found]) + min([0.0, *found])
        return 1 / (1 + math.exp(-z))


SIGNALS = ("exact", "misspelled", "quoted", "abuse", "share", "weight")


def hits(words: list[str], memory: _Memory) -> list[tuple[int, tuple[str, int]]]:
    return [(at, hit) for at, hit in enumerate(map(memory.__getitem__, words)) if hit]


def signals(
    text: str | None, memory: _Memory, terms: dict[str, float], windows: Windows, own: int | None = None
) -> list[float]:
    """What a text's hits add up to, each counted as far as its window makes it abuse, the rest as quoted.

    ``own`` is the label of a text that the windows were learned from.
    """
    words = (text or "").lower().split()
    exact = misspelled = cited = most = weight = 0.0
    for at, (term, edits) in hits(words, memory):
        meant = windows.abuse(words, at, own)
        cited += 1 - meant
        exact, misspelled = exact + meant * (edits == 0), misspelled + meant * (edits > 0)
        most, weight = max(most, meant), max(weight, meant * terms[term])
    share = 100 * (exact + misspelled) / max(len(words), 1)
    return [math.log1p(exact), math.log1p(misspelled), math.log1p(cited), most, min(share, 5.0), weight]


@dataclass(frozen=True)
class ToxicSpec:
    """At most ``max_docs`` labelled documents are learned from. A term must occur in ``support``
    of their toxic documents, between as many separate neighbours, with log-odds of ``odds`` or
    more (a stem of ``stem_odds``). Under 100 toxic documents for each of ``support``, one in a
    hundred is enough, but 3 at least. All such terms are kept, of any length; those of up to
    four letters only match exactly. A cue must stand beside terms in ``cue_support`` documents;
    ``prior`` documents of the usual mix are added to what is known of it."""

    max_docs: int = 6000
    support: int = 5
    odds: float = 3.0
    stem_odds: float = 4.2
    stems: tuple[int, ...] = (4, 5, 6)
    ridge: float = 0.05
    cue_support: int = 3
    prior: float = 2.0


@dataclass(frozen=True)
class ToxicModel:
    terms: dict[str, float]
    weights: np.ndarray
    windows: Windows = Windows()

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _terms_of(texts: Iterable[str], stems: tuple[int, ...]) -> Iterator[list[str]]:
    """The distinct terms of each text: its words, and the stems of those that are longer."""
    for text in texts:
        words = {normal_form(w) for w in (text or "").lower().split()}
        words = {w for w in words if w.isalpha()}
        yield sorted(words | {w[:n] + "*" for w in words for n in stems if len(w) > n})


def _contexts_of(texts: Iterable[str], stems: tuple[int, ...], wanted: frozenset[str]) -> Iterator[list[dict]]:
    """The wanted terms of each text where they stand, with hashes of the words before and behind."""
    for text in texts:
        words = [normal_form(w) for w in (text or "").lower().split()]
        found = []
        for at, w in enumerate(words):
            mine = [t for t in (w, *(w[:n] + "*" for n in stems if len(w) > n)) if t in wanted]
            if mine:
                before, behind = "".join(words[max(0, at - 1) : at]), "".join(words[at + 1 : at + 2])
                left, right = xxhash.xxh64_intdigest(before) >> 1, xxhash.xxh64_intdigest(behind) >> 1
                found += [{"term": t, "left": left, "right": right} for t in mine]
        yield found


def separate_places(group: pa.Table) -> pa.Table:
    """``(term, places)``: how many neighbourhoods of a term share neither side with another one that counts.

    The most frequent go first. Near copies of a text, each edited elsewhere, share a side with
    what they were copied from, so a group of them adds about one place, however large it is.
    """
    rows = sorted(zip(*(group[name].to_pylist() for name in ("n", "left", "right")), strict=True), key=lambda r: (-r[0], r[1:]))
    lefts, rights = set(), set()
    places = 0
    for _, left, right in rows:
        if left not in lefts and right not in rights:
            lefts.add(left)
            rights.add(right)
            places += 1
    return pa.table({"term": group["term"].slice(0, 1), "places": pa.array([places], pa.int64())})


def learn_terms(sample: DataFrame, spec: ToxicSpec) -> dict[str, float]:
    """Terms with their log-odds. A stem counts for all terms it covers unless one of them nearly equals it.

    Copies must not make their words into terms: equal texts count once, and a term must stand
    between enough separate neighbours (see ``separate_places``). Further copies take nothing away.
    """
    once = sample.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("label").alias("label"))
    with cached(once.select("text", "label")) as texts:
        totals = texts.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
        bad, good = totals[0], totals[1]
        if not bad or not good:
            return {}
        least = min(spec.support, max(3, math.ceil(bad / 100)))

        def terms(columns: list[pa.Array]) -> list[pa.Array]:
            return [pa.array(_terms_of(columns[0].to_pylist(), spec.stems), pa.list_(pa.string()))]

        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
        candidates = (
            append_columns(texts, ["text"], {"terms": "array<string>"}, terms, keep=["label"])
            .select(F.explode("terms").alias("term"), (F.col("label") > 0).cast("int").alias("toxic"))
            .groupBy("term")
            .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
            .where(F.col("bad") >= least)
            .select("term", odds.alias("odds"))
            .where(F.col("odds") >= spec.odds)
            .collect()
        )
        odds_of = {r["term"]: float(r["odds"]) for r in candidates}
        wanted = frozenset(odds_of)
        kind = pa.list_(pa.struct([("term", pa.string()), ("left", pa.int64()), ("right", pa.int64())]))

        def contexts(columns: list[pa.Array]) -> list[pa.Array]:
            return [pa.array(list(_contexts_of(columns[0].to_pylist(), spec.stems, wanted)), kind)]

        varied = (
            append_columns(
                texts.where("label > 0"),
                ["text"],
                {"found": "array<struct<term:string,left:bigint,right:bigint>>"},
                contexts,
                keep=[],
            )
            .select(F.inline("found"))
            .groupBy("term", "left", "right")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("term")
            .applyInArrow(separate_places, "term string, places long")
            .where(F.col("places") >= least)
            .collect()
        )
    places = {r["term"]: r["places"] for r in varied}
    found = {t: odds_of[t] for t in places}
    under: dict[str, float] = {}
    # Shortest first; longer stems that a kept stem covers are gone.
    for stem in sorted((t for t in places if t.endswith("*")), key=len):
        if stem not in found:
            continue
        covered = [t for t in places if t != stem and t.startswith(stem[:-1])]
        # Nearly as frequent a longer term says it more exactly; a weak stem would blur others.
        if found[stem] < spec.stem_odds or any(places[t] >= 0.9 * places[stem] for t in covered):
            del found[stem]
        else:
            for t in covered:
                # Whole terms stay for misspellings inside the stem; they weigh what the stem does.
                if t.endswith("*"):
                    found.pop(t, None)
                elif t not in under:
                    under[t] = found[t] = found[stem]
    return found


def learn_windows(sample: DataFrame, terms: dict[str, float], spec: ToxicSpec) -> Windows:
    """Weights of what stands around terms, from the labels of the documents it stands in.

    Equal texts count once, and so does a cue in one text. Tasks find the cues; the driver gets
    two counts for each that enough documents of the bounded sample share.
    """
    held: list[_Memory] = []

    def cues(columns: list[pa.Array]) -> list[pa.Array]:
        if not held:
            held.append(_Memory(Lexicon(terms)))
        made = []
        for text in columns[0].to_pylist():
            words = (text or "").lower().split()
            at = [place for place, _ in hits(words, held[0])]
            # The empty cue counts the documents that have a term at all.
            made.append(sorted({""}.union(*(cues_at(words, place) for place in at))) if at else [])
        return [pa.array(made, pa.list_(pa.string()))]

    once = sample.groupBy(F.xxhash64("text").alias("h"), "text").agg((F.max("label") > 0).cast("int").alias("toxic"))
    found = (
        append_columns(once, ["text"], {"cues": "array<string>"}, cues, keep=["toxic"])
        .select(F.explode("cues").alias("cue"), "toxic")
        .groupBy("cue")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= spec.cue_support) | (F.col("cue") == ""))
        .collect()
    )
    counts = {r["cue"]: (r["bad"], r["n"]) for r in found}
    bad, n = counts.pop("", (0, 0))
    usual = (bad + 1) / (n + 2)
    base = math.log(usual / (1 - usual))

    def over(bad: int, n: int) -> float:
        share = (bad + spec.prior * usual) / (n + spec.prior)
        return math.log(share / (1 - share)) - base

    return Windows(
        {
            cue: (over(bad, n), over(bad, max(n - 1, bad)), over(max(bad - 1, 0), n - 1))
            for cue, (bad, n) in sorted(counts.items())
        },
        base,
    )


def _fit(rows: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton's method."""
    x = np.column_stack([rows, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 3,
    fold: int = 1,
    spec: ToxicSpec = ToxicSpec(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> ToxicModel:
    """Learn terms, their windows and weights from a bounded sample of labelled documents outside the fold.

    Terms are counted in tasks; the driver gets the terms and cues that several documents of the
    sample share, and six numbers for each of at most ``max_docs`` documents. Without labels of both kinds nothing is toxic.
    """
    with cached(training_sample(docs, labels, label, folds, fold, spec.max_docs, doc_id, text)) as sample:
        terms = learn_terms(sample, spec)
        if not terms:  # nothing to tell texts apart by
            return ToxicModel({}, np.append(np.zeros(len(SIGNALS)), -4.0))
        windows = learn_windows(sample, terms, spec)
        rows = with_signals(sample, terms, windows, "text", "signals", "label").select("signals", "label").collect()
    rows.sort(key=lambda r: (r["signals"], r["label"]))
    x = np.array([r["signals"] for r in rows])
    y = np.array([float(r["label"] > 0) for r in rows])
    return ToxicModel(terms, _fit(x, y, spec.ridge), windows)


def with_signals(docs: DataFrame, terms: dict[str, float], windows: Windows, text: str, out: str, own: str) -> DataFrame:
    """All columns of ``docs``, which were learned from with the labels ``own``, plus the array of ``SIGNALS``."""
    held: list[_Memory] = []

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        if not held:
            held.append(_Memory(Lexicon(terms)))
        rows = zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)
        return [pa.array([signals(t, held[0], terms, windows, int(y > 0)) for t, y in rows], pa.list_(pa.float64()))]

    return append_columns(docs, [text, own], {out: "array<double>"}, work)


def with_toxicity(
    docs: DataFrame, model: ToxicModel, text: str = "text", out: str = "score", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) plus the probability that the whole text is toxic, 0 to 1.

    NULL, empty and blank texts have no hits and get the score of such texts. Rows are
    independent; the model (the terms of a bounded sample) travels with the tasks.
    """
    held: list[_Memory] = []

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        if not held:
            held.append(_Memory(Lexicon(model.terms)))
        found = [signals(t, held[0], model.terms, model.windows) for t in columns[0].to_pylist()]
        rows = np.array(found).reshape(len(found), len(SIGNALS))
        return [pa.array(model.probability(rows), pa.float64())]

    return append_columns(docs, [text], {out: "double"}, work, keep=keep)


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``."""
    name = free_name(docs, "score")
    return with_toxicity(docs, model, text, name).where(F.col(name) < threshold).drop(name)
