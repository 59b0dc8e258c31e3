"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by statistics of its letters and
words and a learned layer; gated attention weighs the passages, and the weighted sum is
scored. Labels are known for whole documents only, so encoder, attention and scorer are
learned together from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripkit.llm.common import append_columns, free_name, word_count
from tripkit.llm.learn import training_sample
from tripkit.operators.layout import cached

PASSAGE_WORDS = 64
# So many bytes are encoded at once: some 70 times as much is needed beside them.
_SEGMENT_BYTES = 1 << 18
# How a byte of UTF-8 counts.
_SPACES = (9, 10, 11, 12, 13, 32)
FEATURES = (
    "letters", "capitals", "digits", "marks", "symbols", "beyond_ascii", "long_words", "short_words",
    "bare_marks", "marked_words", "distinct", "stutter", "seen_before", "breaks", "size",
)


def _byte_classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    lower, upper = (code >= 97) & (code <= 122), (code >= 65) & (code <= 90)
    digit, beyond = (code >= 48) & (code <= 57), code >= 128
    marks = (code > 32) & (code < 127) & ~lower & ~upper & ~digit
    symbols = np.isin(code, np.frombuffer(b"#$%&*+/<=>@[]^_`{|}~\\", np.uint8))
    lead = code >= 192
    return {
        "letters": lower | upper | lead, "capitals": upper, "digits": digit, "marks": marks,
        "symbols": symbols, "beyond_ascii": beyond, "breaks": code == 10,
    }


_CLASSES = {name: mask.astype(np.int64) for name, mask in _byte_classes().items()}


def _word_table() -> np.ndarray:
    """Random numbers for (place in word, byte); their sum over a word stands for the word."""
    table = np.random.default_rng(7).integers(0, 2**63, (32, 256), dtype=np.uint64)
    table[:, ord("A") : ord("Z") + 1] = table[:, ord("a") : ord("z") + 1]
    table[:, list(_SPACES)] = 0
    return table


_WORD_TABLE = _word_table()


@dataclass(frozen=True)
class Carry:
    """What the parts of one long text hand on: words so far, the last two, and all runs of three."""

    words: int = 0
    last: np.ndarray = field(default_factory=lambda: np.zeros(2, np.uint64))
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _word_starts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start (a text's first byte may start one), and which bytes are white space."""
    space = np.isin(data, _SPACES)
    opens = ~space
    opens[1:] &= space[:-1]
    opens[bounds] = ~space[bounds]
    return np.flatnonzero(opens), space


def segment_passages(data: np.ndarray, offsets: np.ndarray, carry: Carry = Carry()) -> tuple[np.ndarray, np.ndarray, Carry]:
    """Encode the passages of several texts that lie one behind the other in ``data``.

    Returns the text number and the features of each passage, and what a further part of the
    text needs. A text without words has none. With ``carry`` from an earlier part ``data`` is the next
    part of one text and starts where a passage does.
    """
    starts, space = _word_starts(data, offsets[:-1][offsets[:-1] < offsets[1:]])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, len(FEATURES))), carry
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    nth = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts)))) + carry.words
    heads = np.flatnonzero(nth % PASSAGE_WORDS == 0)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts)

    counts = {name: per_word(mask[data]) for name, mask in _CLASSES.items()}
    size = per_word((~space).astype(np.int64))
    lengths = np.diff(np.append(starts, len(data)))
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    place = np.minimum(place, len(_WORD_TABLE) - 1)
    word = per_word(_WORD_TABLE[place, data])
    passage = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(starts))))

    def is_new(keys: np.ndarray) -> np.ndarray:
        """1 where a key appears for the first time."""
        new = np.zeros(len(keys))
        new[np.unique(keys, return_index=True)[1]] = 1
        return new

    def per_passage(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), heads)

    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        distinct = is_new(word ^ ((passage.astype(np.uint64) + np.uint64(1)) * odd))
        ahead = np.concatenate([carry.last, word])
        run = word * np.uint64(3) + ahead[1:-1] * np.uint64(5) + ahead[:-2] * odd
        run ^= (text.astype(np.uint64) + np.uint64(1)) * odd
        seen = (nth >= 2) * (1 - is_new(run))
        if len(carry.runs):
            seen = np.maximum(seen, np.isin(run, carry.runs))
    stutter = np.append(False, word[1:] == word[:-1]) & (nth % PASSAGE_WORDS > 0)
    n = per_passage(np.ones(len(starts)))
    total = np.maximum(per_passage(size), 1)
    features = np.column_stack([
        per_passage(counts["letters"]) / total,
        per_passage(counts["capitals"]) / total,
        per_passage(counts["digits"]) / total,
        per_passage(counts["marks"]) / total,
        per_passage(counts["symbols"]) / total,
        per_passage(counts["beyond_ascii"]) / total,
        np.log1p(total / n) / 3,
        per_passage(size <= 3) / n,
        per_passage((counts["letters"] == 0) & (counts["digits"] == 0)) / n,
        per_passage(counts["marks"] >= 2) / n,
        per_passage(distinct) / n,
        per_passage(stutter) / n,
        per_passage(seen) / n,
        per_passage(counts["breaks"]) / n,
        np.log1p(n) / 5,
    ])
    after = Carry(int(nth[-1]) + 1, ahead[-2:], np.union1d(carry.runs, run[nth >= 2]) if len(offsets) == 2 else carry.runs)
    return text[heads], features, after


def long_passages(data: np.ndarray) -> np.ndarray:
    """Features of the passages of one text, whatever its length, as if it were encoded at once.

    It is cut where passages start, into parts of about ``_SEGMENT_BYTES``. Runs of words that an
    earlier part has seen are handed on, eight bytes each.
    """
    starts, _ = _word_starts(data, np.zeros(min(1, len(data)), np.int64))
    heads = starts[::PASSAGE_WORDS]
    cuts = [0]
    while (at := int(np.searchsorted(heads, cuts[-1] + _SEGMENT_BYTES))) < len(heads):
        cuts.append(int(heads[at]))
    cuts.append(len(data))
    carry, found = Carry(), [np.zeros((0, len(FEATURES)))]
    for low, high in zip(cuts, cuts[1:], strict=False):
        _, features, carry = segment_passages(data[low:high], np.array([0, high - low]), carry)
        found.append(features)
    return np.concatenate(found)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and features of every passage of an Arrow array of texts, in order.

    Every text has at least one: a NULL, empty or blank text has one of zeros. Texts are taken
    some at a time; a long one is taken by itself (see ``long_passages``).
    """
    values = texts.cast(pa.large_string())
    _, ends, buffer = values.buffers()
    offsets = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    numbers, found = [], []
    at = 0
    while at < len(values):
        to = int(np.searchsorted(offsets, offsets[at] + _SEGMENT_BYTES, "right")) - 1
        to = max(to, at + 1)
        here = offsets[at : to + 1]
        if to == at + 1:
            features = long_passages(data[here[0] : here[1]])
            text = np.zeros(len(features), np.int64)
        else:
            text, features, _ = segment_passages(data[here[0] : here[-1]], here - here[0])
        numbers.append(text + at)
        found.append(features)
        at = to
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    features = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
    bare = np.setdiff1d(np.arange(len(values)), number)
    number = np.concatenate([number, bare])
    features = np.concatenate([features, np.zeros((len(bare), len(FEATURES)))])
    order = np.argsort(number, kind="stable")
    return number[order], features[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class MilSpec:
    """How the model is fitted. At most ``max_docs`` labelled documents are used, with all their
    passages, and so many of them (in the order of a hash) that their passages are at most
    ``max_passages``: both bounds leave out whole documents."""

    max_docs: int = 6000
    max_passages: int = 400_000
    hidden: int = 24
    gates: int = 12
    epochs: int = 30
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class MilModel:
    """Gated attention over encoded passages; a constant where the labels had one class or none."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    constant: float = 0.5

    def score(self, number: np.ndarray, features: np.ndarray, texts: int) -> np.ndarray:
        """One score for each text; ``number`` must be sorted and hold every text."""
        if self.weights is None:
            return np.full(texts, self.constant)
        heads = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, int)
        if not len(heads):
            return np.zeros(0)
        return _forward(self.weights, (features - self.mean) / self.scale, heads)["score"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, heads: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(heads, len(x)))
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (t * g) @ w["a"]
    logit = logit - np.repeat(np.maximum.reduceat(logit, heads), sizes)
    e = np.exp(logit)
    attention = e / np.repeat(np.add.reduceat(e, heads), sizes)
    z = np.add.reduceat(h * attention[:, None], heads)
    return {"sizes": sizes, "h": h, "t": t, "g": g, "attention": attention, "z": z,
            "score": _sigmoid(z @ w["c"] + w["d"][0])}


def _gradients(w: dict, x: np.ndarray, heads: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, heads)
    error = (f["score"] - y) / len(y)
    dz = np.repeat(error[:, None] * w["c"][None, :], f["sizes"], axis=0)
    inner = (dz * f["h"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(inner * f["attention"], heads), f["sizes"])
    dlogit = f["attention"] * (inner - mean)
    dt = dlogit[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = dlogit[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (dz * f["attention"][:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ dlogit, "c": f["z"].T @ error, "d": np.array([error.sum()])}


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, spec: MilSpec = MilSpec()) -> MilModel:
    """Fit the model to bags of passage features and one 0/1 label for each bag."""
    width = len(FEATURES)
    if not len(bags) or labels.min() == labels.max():
        constant = float(labels.mean()) if len(bags) else 0.5
        return MilModel(np.zeros(width), np.ones(width), None, constant)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [(bag - mean) / scale for bag in bags]
    rng = np.random.default_rng(spec.seed)
    shapes = {"W": (width, spec.hidden), "b": (spec.hidden,), "V": (spec.hidden, spec.gates),
              "U": (spec.hidden, spec.gates), "a": (spec.gates,), "c": (spec.hidden,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(shape[0]), shape) * (k not in "bd") for k, shape in shapes.items()}
    first, second, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(spec.epochs):
        rate = spec.rate * (1 - epoch / spec.epochs)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), spec.batch):
            mine = order[at : at + spec.batch]
            x = np.concatenate([bags[i] for i in mine])
            heads = np.concatenate([[0], np.cumsum([len(bags[i]) for i in mine])[:-1]])
            step += 1
            for k, g in _gradients(w, x, heads, labels[mine]).items():
                g = g + spec.decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                w[k] = w[k] - rate * move
    return MilModel(mean, scale, w)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 5,
    fold: int = 0,
    spec: MilSpec = MilSpec(),
    doc_id: str = "doc_id",
    text: str = "text",
) -> MilModel:
    """Learn from a bounded sample of labelled documents outside the held-out fold.

    Passages are encoded in tasks; the driver gets the features of at most ``spec.max_passages``
    passages, and before that the size of each sampled document. Without labels of both kinds
    the model is a constant.
    """

    def bag(columns: list[pa.Array]) -> list[pa.Array]:
        number, features = passages(columns[0])
        heads = np.searchsorted(number, np.arange(len(columns[0]) + 1))
        made = [features[a:b].astype(np.float32).tobytes() for a, b in zip(heads, heads[1:], strict=False)]
        return [pa.array(made, pa.binary())]

    with cached(training_sample(docs, labels, label, folds, fold, spec.max_docs, doc_id, text)) as sample:
        size = F.ceil(word_count(F.col("text")) / PASSAGE_WORDS)
        marks = sample.select(F.xxhash64("text", "label").alias("mark"), F.greatest(size, F.lit(1)).alias("size")).collect()
        marks.sort()
        last = np.searchsorted(np.cumsum([r["size"] for r in marks]), spec.max_passages, "right")
        chosen = sample
        if last < len(marks):
            kept = sorted({r["mark"] for r in marks[:last]} - {r["mark"] for r in marks[last:]})
            table = docs.sparkSession.createDataFrame([(m,) for m in kept], "mark long")
            chosen = sample.join(F.broadcast(table), F.xxhash64("text", "label") == F.col("mark"), "left_semi")
        rows = append_columns(chosen, ["text"], {"bag": "binary"}, bag, keep=["label"]).collect()
    rows.sort(key=lambda r: (bytes(r["bag"]), r["label"]))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in rows]
    return fit_bags(bags, np.array([float(r["label"] > 0) for r in rows]), spec)


def with_quality(
    docs: DataFrame, model: MilModel, text: str = "text", out: str = "score", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) plus the probability that the text is of quality, 0 to 1.

    Every passage of the whole text counts. NULL, empty and blank texts are scored as one
    passage of zeros. Rows are independent.
    """

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        number, features = passages(columns[0])
        return [pa.array(model.score(number, features, len(columns[0])), pa.float64())]

    return append_columns(docs, [text], {out: "double"}, work, keep=keep)


def keep_quality(docs: DataFrame, model: MilModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""
    name = free_name(docs, "score")
    return with_quality(docs, model, text, name).where(F.col(name) >= threshold).drop(name)
