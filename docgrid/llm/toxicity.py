"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only the document has a label.

A sentence's log-odds are a bias and the sum of its different words' weights (a word that is said twice counts
once); a word's weight is the sum over its character n-grams (word ends marked) and itself. A document's
probability is the noisy-or of its sentences': it is toxic unless every sentence is clean. The weights are fitted
on document labels through the noisy-or, so the sentence scores that come out of it also say where the offending
sentences are.

Fitting takes at most FIT_ROWS labelled documents in the order of a hash of doc_id (the bound of the fit), half of
them toxic where there are so many, weighted back to the true rate, and every sentence of each. N-grams are counted
and ranked by an aggregate; FEATURES of them with the largest lift enter. Texts are packed to numbers and passed
over on executors (see averaging); the driver gets n-grams and parameters only. FEATURES and ROUNDS were chosen on
a fold of the learning rows, not on held-out ones.

Scoring reads whole texts. Nulls: a null text is empty and has the score of no sentence, 0. Null or missing labels
are not learnt from; if one of the two labels is missing altogether every sentence has the bias. doc_id may be null
or repeat: one row per row. Other columns are not looked at.
"""

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.llm.averaging import Parameters, adam, averaged, dealt, passes, with_moments
from docgrid.llm.common import label_rate, labelled_sample, text_or_empty

FIT_ROWS = 4000
FEATURES = 1500
GRAMS = (4, 5)
#: N-grams of fewer texts of the sample can't enter.
LEAST_TEXTS = 4
ROUNDS, STEPS, MINIBATCH, RATE, FLOOR = 12, 16, 50, 0.08, 1e-9
#: Words whose weights a task remembers.
REMEMBERED = 100_000
#: Texts that are taken out of a batch at a time.
TOGETHER = 256
WORD = re.compile(r"\w+")
#: What stands between these is a sentence, if it has words.
SENTENCE = re.compile(r"[^.!?\n]+")


def grams(word: str) -> tuple[str, ...]:
    """The word with its ends marked, and its character n-grams, each once."""
    marked = f"<{word}>"
    return tuple(dict.fromkeys([marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]))


class Weights(dict):
    """Word to weight; computed when missing, forgotten when too many."""

    def __init__(self, of: dict[str, float]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> float:
        get = self.of.get
        value = sum(get(g, 0.0) for g in grams(word))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._of: Weights | None = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "_of": None}

    def sentence_odds(self, text: str) -> np.ndarray:
        """Log-odds of each sentence, in order."""
        if self._of is None:
            self._of = Weights(self.weights)
        weight = self._of.__getitem__
        return np.array([sum(map(weight, s)) for s in _sentences(text)], float) + self.bias

    def score(self, text: str) -> float:
        """The noisy-or over the sentences."""
        return noisy_or(self.sentence_odds(text))

    def offending(self, text: str, odds: np.ndarray | None = None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) of sentences that reach `least`; places are code points of the text.

        odds: the sentences' log-odds, if known.
        """
        odds = self.sentence_odds(text) if odds is None else odds
        scores = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        spans = []
        for m in SENTENCE.finditer(text):
            words = [w.span() for w in WORD.finditer(m.group())]
            if words:
                spans.append((m.start() + words[0][0], m.start() + words[-1][1]))
        return [(a, b, float(s)) for (a, b), s in zip(spans, scores, strict=True) if s >= least]


def noisy_or(odds: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, odds).sum()))


def _sentences(text: str) -> list[dict[str, None]]:
    """The different words of each sentence, in order."""
    return [words for part in SENTENCE.findall(text.lower()) if (words := dict.fromkeys(WORD.findall(part)))]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n0, n1): in how many texts of either label an n-gram occurs, in parts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                seen[label].update({g for w in {w for s in _sentences(text) for w in s} for g in grams(w)})
            names = [*{**seen[0], **seen[1]}]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(names, pa.string()), **{f"n{y}": pa.array([seen[y][g] for g in names], pa.int64()) for y in (0, 1)}})


def chosen_grams(sample: DataFrame, counts: dict[int, int], features: int) -> list[str]:
    """The n-grams with the largest lift, counted and ranked on executors; at most `features` come to the driver."""
    in1, in0, n1, n0 = F.col("n1"), F.col("n0"), counts[1], counts[0]
    lift = F.abs(in1 / n1 - in0 / n0) * F.abs(F.log((in1 + 1) * (n0 + 2) / (n1 + 2) / (in0 + 1)))
    counted = sample.select("text", "label").mapInArrow(_gram_counts, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return [r.gram for r in counted.where(in0 + in1 >= LEAST_TEXTS).select("gram", lift.alias("lift")).orderBy(F.desc("lift"), "gram").limit(features).collect()]


def _packed(sample: DataFrame, names: list[str]) -> DataFrame:
    """(label, columns, sizes, h): of each text the chosen n-grams of all its sentences, as 32-bit numbers, and how many each sentence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = {g: k for k, g in enumerate(names)}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part, columns, sizes = batch.slice(at, TOGETHER), [], []
                for text in part.column("text").to_pylist():
                    own, size = array("i"), array("i")
                    for s in _sentences(text):
                        before = len(own)
                        for w in s:
                            if w not in known:
                                if len(known) >= REMEMBERED:
                                    known.clear()
                                known[w] = [index[g] for g in grams(w) if g in index]
                            own.extend(known[w])
                        size.append(len(own) - before)
                    columns.append(own.tobytes())
                    sizes.append(size.tobytes())
                yield pa.RecordBatch.from_pydict({"label": part.column("label"), "columns": pa.array(columns, pa.binary()), "sizes": pa.array(sizes, pa.binary()), "h": part.column("h")})

    return sample.select("text", "label", "h").mapInArrow(run, "label int, columns binary, sizes binary, h long")


def gradients(now: Parameters, columns: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Parameters:
    """Of the mean weighted cross-entropy of the noisy-or."""
    column, size, w = np.concatenate(columns), np.concatenate(sizes), now["weights"]
    owner, sentence = np.repeat(np.arange(len(y)), [len(s) for s in sizes]), np.repeat(np.arange(len(size)), size)
    odds = np.bincount(sentence, w[column], len(size)) + now["bias"]
    clean = np.bincount(owner, np.logaddexp(0, odds), len(y))  # minus the log of the chance that all are clean
    toxic = np.maximum(-np.expm1(-clean), 1e-9)
    d = (np.where(y == 1, -(1 - toxic) / toxic, 1.0) * weight / len(y))[owner] / (1 + np.exp(-np.clip(odds, -30, 30)))
    return {"weights": np.bincount(column, d[sentence], len(w)) + 1e-6 * w, "bias": d.sum()}


def fit_toxicity(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """A model from labels (doc_id, toxic) of documents that aren't held out."""
    sample = pinned(labelled_sample(documents, labels, "toxic", rows))
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model({}, 5.0 if 1 in counts else -5.0)
    base, share = label_rate(labels, "toxic"), counts[1] / sum(counts.values())
    names = chosen_grams(sample, counts, features)

    def local(now: Parameters, batches: Iterable[pa.RecordBatch], nth: int) -> int:
        rate, seen = RATE * (1 - nth / ROUNDS) + 0.001, 0
        for batch in batches:
            for at in range(0, batch.num_rows, MINIBATCH):
                part = batch.slice(at, MINIBATCH)
                y = part.column("label").to_numpy()
                columns, sizes = ([np.frombuffer(x, np.int32) for x in part.column(c).to_pylist()] for c in ("columns", "sizes"))
                adam(now, gradients(now, columns, sizes, y, np.where(y == 1, base / share, (1 - base) / (1 - share))), rate, FLOOR)
                seen += len(y)
        return seen

    shards = dealt(_packed(sample, names))
    found = averaged(shards, with_moments({"weights": np.zeros(len(names)), "bias": np.array(-5.0)}), ROUNDS, local, passes(sum(counts.values()), MINIBATCH, STEPS))
    shards.unpersist()
    return Model({g: float(w) for g, w in zip(names, found["weights"], strict=True) if abs(w) > 1e-4}, float(found["bias"]))


def score_toxicity(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences): of documents that reach `least`, the offending sentences as (start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column(1).to_pylist()
                odds = [model.sentence_odds(x) for x in texts]
                scores = [noisy_or(o) for o in odds]
                found = [[{"start": a, "end": b, "score": s} for a, b, s in model.offending(x, o)] if p >= least else [] for x, o, p in zip(texts, odds, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "sentences"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double, sentences array<struct<start: long, end: long, score: double>>")
