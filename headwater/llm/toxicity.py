"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a token. Word: its smoothed log odds between toxic and clean training texts, and whether it was
seen. Characters: the same odds of its start of three and of six letters, and the greatest and the mean of
those of all its four-letter pieces, word ends marked, so a new form of a known stem is recognised; its
length, and whether marks stand around it. All pieces of a word count, however long it is.

Network. A gated recurrent unit runs over a window of words in each direction; attention over both
states pools the window; a linear layer gives its logit. Windows of ``WINDOW`` words start every
``STRIDE`` words, so any phrase shorter than their overlap is whole in some window. All windows of a
text are scored, and the text takes the greatest: one insult in a long text counts.

Training is multiple-instance: a text's label belongs to its greatest window, chosen anew each round. It
takes ``STEPS`` steps whatever the sample's size, over at most ``per_class`` labelled texts of each label
(2,000 by default; at most 1 MB each and 64 MB in all). A text's odds come from the folds that it is not
in, so neither the network nor the curve that makes logits scores sees odds that a text itself produced.
The curve weighs both labels the same: a half is where either is as likely. Nothing but the text is an
input. The broadcast model is a few megabytes at most, bounded by the sample.

A null or empty text, or one without words, scores as one padded window. With fewer than ``FOLDS`` distinct
texts of a label in the sample there is nothing to train on, and every score is the share of toxic labels
(0 without any label). Repeated rows each get their row, ties need no order, a null id stays null, an empty
table gives an empty result, and extra columns are never read. Windows are scored in bounded batches, so a
text of any length is scored whole.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, distinct_texts, give_back, held_out, labelled_sample, map_texts

WINDOW, STRIDE = 32, 24
HIDDEN, KEYS = 8, 8
FEATURES = 8
FOLDS = 4
STEPS, ROUNDS = 600, 5
PER_CLASS = 2000
BATCH_WINDOWS = 2048
EDGE = ".,;:!?\"'()[]{}*$&%#|-_<>/\\"


def split_words(text: str) -> list[str]:
    return text.lower().split()


def pieces_of(word: str) -> list[str]:
    """The word's start of three and of six letters and all its runs of four, its ends marked."""
    marked = f"^{word}$"
    return [marked[:4], marked[:7], *(marked[i : i + 4] for i in range(1, len(marked) - 3))]


@dataclass
class Vocabulary:
    """Log odds of words and of character pieces, from counts over training texts."""

    words: dict[str, float] = field(default_factory=dict)
    pieces: dict[str, float] = field(default_factory=dict)

    def inputs(self, words: list[str], block: int = 8192) -> np.ndarray:
        """FEATURES numbers of each word, made for a block of words at a time."""
        made = np.empty((len(words), FEATURES), np.float32)
        for s in range(0, len(words), block):
            made[s : s + block] = self._inputs(words[s : s + block])
        return made

    def _inputs(self, words: list[str]) -> np.ndarray:
        get, seen, flat, sizes, own = self.pieces.get, self.words.get, [], [], []
        for word in words:
            bare = word.strip(EDGE)
            found = [get(p, 0.0) for p in pieces_of(bare)]
            flat += found
            sizes.append(len(found))
            odds = seen(bare)
            own.append((odds or 0.0, odds is None, found[0], found[1], min(len(bare), 20) / 10, bare != word))
        flat, sizes, own = np.array(flat, np.float32), np.array(sizes), np.array(own, np.float32)
        starts = np.cumsum(sizes) - sizes
        return np.column_stack([own[:, :4], np.maximum.reduceat(flat, starts), np.add.reduceat(flat, starts) / sizes, own[:, 4:]])


class Counts:
    """Over training texts in folds: how many of each label hold each word, and the same summed over the words of each piece.

    Items are numbered once; what is held beside their names is a number for each item, fold and label.
    """

    def __init__(self, folds: list[list[tuple[str, int]]]):
        self.names: list[dict[str, int]] = [{}, {}]
        words, grams = self.names
        parts: list[list] = [[], []]
        for rows in folds:
            for y in (0, 1):
                held = Counter(w for text, label in rows if label == y for w in {w.strip(EDGE) for w in split_words(text)})
                own, pieces, times = array("q"), array("q"), array("q")
                for word, n in held.items():
                    own.append(words.setdefault(word, len(words)))
                    for piece in set(pieces_of(word)):
                        pieces.append(grams.setdefault(piece, len(grams)))
                        times.append(n)
                parts[0].append((own, array("q", held.values())))
                parts[1].append((pieces, times))
        self.tables = [np.zeros((len(folds), 2, len(names)), np.float32) for names in self.names]
        for table, part in zip(self.tables, parts, strict=True):
            for row, (i, n) in zip(table.reshape(len(part), -1), part, strict=True):
                row[:] = np.bincount(np.array(i, np.int64), np.array(n, np.int64), len(row))

    def vocabulary(self, used: list[int], least: int = 3) -> Vocabulary:
        """The odds by some of the folds."""
        found = []
        for names, table in zip(self.names, self.tables, strict=True):
            b, a = table[used].sum(axis=0, dtype=np.float64)
            odds = (np.log((a + 0.5) / (a.sum() + 1)) - np.log((b + 0.5) / (b.sum() + 1))) * (a + b) / (a + b + 4)
            kept = a + b >= least
            found.append({name: float(odds[k]) for name, k in names.items() if kept[k]})
        return Vocabulary(*found)


class Tokens:
    """Places of words in a table of the network's input sums, which grows as words come."""

    def __init__(self, most: int = 100_000, most_chars: int = 16_000_000):
        self.most, self.most_chars = most, most_chars
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.fresh: list[str] = []
        self.table = np.zeros((6 * HIDDEN, 1), np.float32)
        self.filled = self.chars = 0

    def ids(self, words: list[str]) -> list[int]:
        index = self.index
        out = [index.get(w, -1) for w in words]
        if -1 in out:
            for k, at in enumerate(out):
                if at < 0:
                    word = words[k]
                    at = index.get(word, -1)
                    if at < 0:
                        at = index[word] = len(index)
                        self.fresh.append(word)
                        self.chars += len(word)
                    out[k] = at
        return out

    def fill(self, model: ToxicityModel) -> None:
        """Add the new words' columns to the table."""
        if self.fresh:
            end = self.filled + len(self.fresh)
            if end > self.table.shape[1]:
                grown = np.zeros((6 * HIDDEN, max(end, 2 * self.table.shape[1])), np.float32)
                grown[:, : self.filled] = self.table[:, : self.filled]
                self.table = grown
            self.table[:, self.filled : end] = model.gates(model.vocabulary.inputs(self.fresh))
            self.filled, self.fresh = end, []


def windows_of(ids: list[int]) -> np.ndarray:
    """(windows, WINDOW) token ids, padded at the end with -1; the last window ends with the text."""
    n = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "W": normal(6 * HIDDEN, FEATURES, scale=FEATURES**-0.5),
        "b": np.zeros((6 * HIDDEN, 1), np.float32),
        "U": normal(2, 3 * HIDDEN, HIDDEN, scale=HIDDEN**-0.5),
        "A": normal(KEYS, 2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
        "a": np.zeros((KEYS, 1), np.float32),
        "v": normal(KEYS, scale=KEYS**-0.5),
        "u": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
        "c": np.zeros(1, np.float32),
    }


def run_network(p: dict[str, np.ndarray], gates: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Logits of windows. gates: (6H, tokens) input sums by token id; ids: (windows, WINDOW), -1 is padding.

    keep: also return what the backward pass needs.
    """
    n, h = len(ids), HIDDEN
    mask = (ids >= 0).T.astype(gates.dtype)  # (T, n)
    at = np.maximum(ids, 0).T
    states = np.zeros((WINDOW, 2 * h, n), gates.dtype)
    steps: list[list] = [[], []]
    for d in (0, 1):
        state = np.zeros((h, n), gates.dtype)
        own = gates[3 * h * d : 3 * h * (d + 1)]
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            x = own.take(at[t], axis=1)
            y = p["U"][d] @ state
            rz = sigmoid(x[: 2 * h] + y[: 2 * h])
            r, z = rz[:h], rz[h:]
            new = np.tanh(x[2 * h :] + r * y[2 * h :])
            after = state + mask[t] * (1 - z) * (new - state)
            if keep:
                steps[d].append((t, state, r, z, new, y[2 * h :]))
            state = after
            states[t, h * d : h * (d + 1)] = state
    keys = np.tanh(np.einsum("kh,thn->tkn", p["A"], states, optimize=True) + p["a"])
    weight = np.einsum("k,tkn->tn", p["v"], keys, optimize=True)
    weight = np.where(mask > 0, weight, -30)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, None] * states).sum(axis=0)
    logit = p["u"] @ pooled + p["c"][0]
    return (logit, (mask, states, steps, keys, weight, pooled)) if keep else logit


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, ids: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over windows and its gradients. inputs: (FEATURES, tokens)."""
    gates = p["W"] @ inputs + p["b"]
    logit, (mask, states, steps, keys, weight, pooled) = run_network(p, gates, ids, keep=True)
    n, h = len(ids), HIDDEN
    loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    out = (sigmoid(logit) - target) / n
    g["u"], g["c"][0] = pooled @ out, out.sum()
    d_pooled = p["u"][:, None] * out
    d_states = weight[:, None] * d_pooled
    d_weight = (states * d_pooled).sum(axis=1)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0)) * (mask > 0)
    g["v"] = (keys * d_score[:, None]).sum(axis=(0, 2))
    d_keys = d_score[:, None] * p["v"][:, None] * (1 - keys**2)
    g["A"] = np.einsum("tkn,thn->kh", d_keys, states, optimize=True)
    g["a"] = d_keys.sum(axis=(0, 2))[:, None]
    d_states += np.einsum("kh,tkn->thn", p["A"], d_keys, optimize=True)
    d_gates = np.zeros_like(gates)
    at = np.maximum(ids, 0).T
    for d in (0, 1):
        d_state = np.zeros((h, n), gates.dtype)
        for t, state, r, z, new, y_new in reversed(steps[d]):
            d_state = d_state + d_states[t, h * d : h * (d + 1)]
            m = mask[t]
            d_new = d_state * m * (1 - z) * (1 - new**2)
            d_z = -d_state * m * (new - state) * z * (1 - z)
            d_r = d_new * y_new * r * (1 - r)
            d_y = np.vstack([d_r, d_z, d_new * r])
            d_x = np.vstack([d_r, d_z, d_new])
            g["U"][d] += d_y @ state.T
            np.add.at(d_gates.T, at[t], np.pad(d_x.T, ((0, 0), (3 * h * d, 3 * h * (1 - d)))))
            d_state = d_state * (1 - m * (1 - z)) + p["U"][d].T @ d_y
    g["W"], g["b"] = d_gates @ inputs.T, d_gates.sum(axis=1, keepdims=True)
    return loss, g


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    parameters: dict[str, np.ndarray]
    scale: float
    shift: float
    prior: float

    def gates(self, values: np.ndarray) -> np.ndarray:
        """Input sums of tokens, (6H, tokens)."""
        made = self.parameters["W"] @ values.T
        made += self.parameters["b"]
        return made


def greatest(logits: np.ndarray, starts: list[int]) -> np.ndarray:
    return np.maximum.reduceat(logits, starts) if len(starts) else np.zeros(0)


def score_texts(texts: list[str], model: ToxicityModel, tokens: Tokens) -> np.ndarray:
    """Scores of whole texts. tokens: reused between calls of one task."""
    if not model.parameters or not texts:
        return np.full(len(texts), model.prior)
    if len(tokens.index) > tokens.most or tokens.chars > tokens.most_chars:
        tokens.clear()
    found = [windows_of(tokens.ids(split_words(t))) for t in texts]
    tokens.fill(model)
    starts = np.cumsum([0, *map(len, found)])[:-1].tolist()
    every = np.concatenate(found)
    logits = np.concatenate([run_network(model.parameters, tokens.table, every[s : s + BATCH_WINDOWS]) for s in range(0, len(every), BATCH_WINDOWS)])
    return sigmoid(np.clip(model.scale * greatest(logits, starts).astype(np.float64) + model.shift, -30, 30))


@dataclass
class Sample:
    """Windows of labelled texts, their words' inputs, and where each text's windows start."""

    windows: np.ndarray
    starts: np.ndarray
    labels: np.ndarray
    values: np.ndarray

    def logits(self, model: ToxicityModel) -> np.ndarray:
        """A batch of windows at a time, with the input sums of its own tokens only."""
        found = []
        for s in range(0, len(self.windows), BATCH_WINDOWS):
            ids = self.windows[s : s + BATCH_WINDOWS]
            distinct, local = np.unique(ids, return_inverse=True)
            gates = model.gates(self.values[np.maximum(distinct, 0)])
            found.append(run_network(model.parameters, gates, np.where(ids >= 0, local.reshape(ids.shape), -1)))
        return np.concatenate(found)


def read_sample(parts: Iterable[tuple[list[tuple[str, int]], Vocabulary]]) -> Sample:
    """(text, label) rows, each part read with its own vocabulary; only one part's words and vocabulary are held."""
    found, values, labels = [], [], []
    for rows, vocabulary in parts:
        tokens, shift = Tokens(), sum(map(len, values))
        for text, y in rows:
            ids = windows_of(tokens.ids(split_words(text)))
            found.append(np.where(ids >= 0, ids + shift, -1))
            labels.append(y)
        values.append(vocabulary.inputs(tokens.fresh or [""]))
        del tokens, vocabulary
    return Sample(np.concatenate(found), np.cumsum([0, *map(len, found)])[:-1], np.array(labels, np.float32), np.concatenate(values))


def train(model: ToxicityModel, sample: Sample, steps: int = STEPS, batch: int = 64, rate: float = 0.01) -> np.ndarray:
    """Adam over each text's greatest window, chosen anew by round, and a random one of each clean text; each text's last greatest logit."""
    p, rng, step = model.parameters, np.random.default_rng(11), 0
    starts, ends = sample.starts.tolist(), [*sample.starts[1:].tolist(), len(sample.windows)]
    evidence = np.maximum(sample.values[:, 0], 0) + np.maximum(sample.values[:, 4], 0)
    logits = np.where(sample.windows >= 0, evidence[np.maximum(sample.windows, 0)], 0).max(axis=1)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for _ in range(ROUNDS):
        top = np.array([s + int(np.argmax(logits[s:e])) for s, e in zip(starts, ends, strict=True)])
        plain = np.array([rng.integers(s, e) for s, e, y in zip(starts, ends, sample.labels, strict=True) if y == 0])
        chosen, target = np.concatenate([top, plain]), np.concatenate([sample.labels, np.zeros(len(plain), np.float32)])
        for _ in range(steps // ROUNDS):
            step += 1
            own = rng.integers(0, len(chosen), batch)
            ids = sample.windows[chosen[own]]
            distinct, local = np.unique(np.append(ids.ravel(), -1), return_inverse=True)
            local = local[:-1].reshape(ids.shape) - 1
            if len(distinct) == 1:
                continue
            _, g = gradients(p, sample.values[distinct[1:]].T, local, target[own])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            pace = rate * max(0.05, 1 - step / steps)
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        logits = sample.logits(model)
    return greatest(logits, starts)


def fit(sample: list[tuple[str, int]], toxic_share: float | None = None, steps: int = STEPS) -> ToxicityModel:
    """A model from (text, label) rows in a fixed order."""
    share = toxic_share if toxic_share is not None else (sum(y for _, y in sample) / len(sample) if sample else 0.0)
    by = {y: distinct_texts([t for t, label in sample if label == y]) for y in (0, 1)}
    if min(map(len, by.values())) < FOLDS:
        return ToxicityModel(Vocabulary(), {}, 1.0, 0.0, share)
    folds = [[(t, y) for y in (0, 1) for t in by[y][k::FOLDS]] for k in range(FOLDS)]
    counts = Counts(folds)
    read = read_sample((folds[k], counts.vocabulary([j for j in range(FOLDS) if j != k])) for k in range(FOLDS))
    model = ToxicityModel(counts.vocabulary(list(range(FOLDS))), new_parameters(), 1.0, 0.0, share)
    del counts
    top = train(model, read, steps)
    from .compression import logistic

    w = logistic(np.column_stack([np.ones(len(top)), top]), read.labels.astype(float), 0.1)
    model.scale, model.shift = float(max(w[1], 0.1)), float(w[0] - np.log(read.labels.mean() / (1 - read.labels.mean())))
    return model


def fit_labels(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on the bounded sample; the share of each label is counted over all learnable labels."""
    counts = dict(labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy(F.col(label).cast("int")).count().collect())
    total = sum(counts.values())
    model = fit(labelled_sample(docs, labels, label, per_class), counts.get(1, 0) / total if total else 0.0)
    give_back()
    return model


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, the kept columns, score), one row for each input row."""
    held = df.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in (id_col, *keep)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        tokens = Tokens()
        for batch in batches:
            made = []
            for _, texts in chunks(iter([batch.select([0, 1])])):
                made.append(score_texts(texts, own, tokens))
            kept = [batch.column(0), *(batch.column(2 + i) if c != text_col else batch.column(1) for i, c in enumerate(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate([np.zeros(0), *made]))], [id_col, *keep, "score"])

    return map_texts(df, id_col, text_col, run, schema, *keep)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit_labels(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
