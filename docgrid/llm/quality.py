"""Quality classifier: a convolutional network over bytes, in numpy.

The bytes of a whole document are covered by overlapping chunks. Filters of WIDTH symbols (a weight for each byte
value, and for the place after a text's end, at each place) slide over a chunk and are max-pooled over it. FAR of
the filters take every STRIDE-th symbol, so they also see how far a text reaches. A small layer turns the pooled
filters into chunk features, whose mean and maximum over the document's chunks give one probability. Chunks overlap by
OVERLAP symbols, so filters over neighbours see every place; those over every STRIDE-th symbol reach over 321 and begin
at 192 of each 448 places, so they sample a text's layout rather than see every pattern in it.

Fitting takes at most FIT_ROWS labelled documents, in the order of a hash of doc_id (the bound of the fit), and
every chunk of each. It runs on executors (see averaging); the driver gets parameters only. The sizes and rounds
were chosen on a fold of the learning rows, not on held-out ones. Scoring reads every byte.

Nulls: a null text is empty; an empty text is one chunk without bytes and gets a score like any other. Null or
missing labels are not learnt from; if one of the two labels is missing altogether, every score is the base
rate. doc_id may be null or repeat: one row per row. Other columns are not looked at.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.llm.averaging import Parameters, adam, averaged, dealt, passes, with_moments
from docgrid.llm.common import label_rate, labelled_sample, text_or_empty

CHUNK = 512
OVERLAP = 64
WIDTH = 6
FILTERS = 32
#: Filters over every STRIDE-th symbol; the others see neighbours.
FAR, STRIDE = 8, 64
HIDDEN = 16
#: The symbol after a text's end, beside the 256 bytes.
END = 256
SYMBOLS = 257
FIT_ROWS = 3200
ROUNDS, STEPS, MINIBATCH, RATE, FLOOR = 10, 25, 16, 0.01, 1e-6
THRESHOLD = 0.3
#: Chunks that are pooled at a time.
TOGETHER = 32
#: (filters, distance of neighbouring symbols) of the two kinds.
KINDS = [(slice(0, FAR), STRIDE), (slice(FAR, FILTERS), 1)]
DISTANCES = np.where(np.arange(FILTERS) < FAR, STRIDE, 1)


def chunks(data: bytes) -> np.ndarray:
    """(n, CHUNK) symbols; neighbours share OVERLAP bytes, END fills the last."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.full(n * step + OVERLAP, END, np.uint16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def initial(base_rate: float = 0.5, seed: int = 7) -> Parameters:
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    conv = f32(WIDTH, SYMBOLS, FILTERS, scale=0.3)
    conv[:, END] = 0
    odds = np.float32(np.log(base_rate / (1 - base_rate)))
    return {"conv": conv, "conv_bias": np.zeros(FILTERS, np.float32), "hidden": f32(FILTERS, HIDDEN, scale=FILTERS**-0.5), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": f32(2 * HIDDEN, scale=0.1), "out_bias": np.array(odds)}


class Network:
    """Scores by given parameters."""

    def __init__(self, parameters: Parameters) -> None:
        self.parameters = parameters
        self._pairs: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"parameters": self.parameters, "_pairs": None}

    def _tables(self) -> list[np.ndarray]:
        """Filters of two symbols at a time, of either kind: (WIDTH / 2, SYMBOLS ** 2, filters)."""
        if self._pairs is None:
            conv = self.parameters["conv"]
            self._pairs = [np.stack([(conv[k][None, :, own] + conv[k + 1][:, None, own]).reshape(SYMBOLS**2, -1) for k in range(0, WIDTH, 2)]) for own, _ in KINDS]
        return self._pairs

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """(n, FILTERS): each filter's largest answer in each chunk."""
        out = np.empty((len(data), FILTERS), np.float32)
        for at in range(0, len(data), TOGETHER):
            part = data[at : at + TOGETHER].astype(np.int32)
            for tables, (own, step) in zip(self._tables(), KINDS, strict=True):
                pair = part[:, :-step] + part[:, step:] * SYMBOLS
                places = CHUNK - (WIDTH - 1) * step
                total = tables[0][pair[:, :places]]
                for k in range(1, WIDTH // 2):
                    total += tables[k][pair[:, 2 * k * step : 2 * k * step + places]]
                out[at : at + TOGETHER, own] = total.max(axis=1)
        return np.maximum(out + self.parameters["conv_bias"], 0)

    def combined(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of documents whose chunks begin at `starts`."""
        return _combined(self.parameters, pooled, starts)[2]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores of an array of strings, of which few are taken out at a time."""
        out = [np.zeros(0)]
        for at in range(0, len(texts), TOGETHER):
            own = [chunks(x.encode("utf-8", "replace")) for x in texts[at : at + TOGETHER].to_pylist()]
            out.append(self.combined(self.pooled(np.concatenate(own)), np.cumsum([0, *map(len, own[:-1])])))
        return np.concatenate(out)


def _combined(p: Parameters, pooled: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk features, their mean and maximum for each document, probabilities)."""
    feature = np.tanh(pooled @ p["hidden"] + p["hidden_bias"])
    sizes = np.diff(np.append(starts, len(pooled)))
    both = np.hstack([np.add.reduceat(feature, starts) / sizes[:, None], np.maximum.reduceat(feature, starts)])
    return feature, both, 1 / (1 + np.exp(-np.clip(both @ p["out"] + p["out_bias"], -30, 30)))


def gradients(p: Parameters, data: np.ndarray, starts: np.ndarray, y: np.ndarray, w: np.ndarray) -> Parameters:
    """Of the mean over documents of the weighted cross-entropy; beside data, holds fewer bytes than data has."""
    n = len(data)
    best, top = np.empty((n, FILTERS), np.int16), np.empty((n, FILTERS), np.float32)
    for own, step in KINDS:
        filters, places = np.ascontiguousarray(p["conv"][:, :, own]), CHUNK - (WIDTH - 1) * step
        for at in range(0, n, TOGETHER):
            part = data[at : at + TOGETHER]
            total = filters[0][part[:, :places]]
            for k in range(1, WIDTH):
                total += filters[k][part[:, k * step : k * step + places]]
            best[at : at + TOGETHER, own] = total.argmax(axis=1)
            top[at : at + TOGETHER, own] = total.max(axis=1)
    raw = top + p["conv_bias"]
    pooled = np.maximum(raw, 0)
    feature, both, found = _combined(p, pooled, starts)
    sizes = np.diff(np.append(starts, n))
    owner = np.repeat(np.arange(len(starts)), sizes)
    error = ((found - y) * w / len(y)).astype(np.float32)
    d_both = error[:, None] * p["out"]
    d_feature = d_both[owner, :HIDDEN] / sizes[owner, None] + d_both[owner, HIDDEN:] * (feature == both[owner, HIDDEN:])
    d_hidden = d_feature * (1 - feature**2)
    d_raw = (d_hidden @ p["hidden"].T) * (raw > 0)
    conv = 1e-6 * p["conv"]
    column = np.arange(FILTERS)[None, :]
    for at in range(0, n, 32 * TOGETHER):
        part, place, pull = (x[at : at + 32 * TOGETHER] for x in (data, best, d_raw))
        for k in range(WIDTH):
            symbol = np.take_along_axis(part, place.astype(np.int64) + k * DISTANCES, axis=1).astype(np.int64)
            conv[k] += np.bincount((symbol * FILTERS + column).ravel(), pull.ravel(), SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
    return {
        "conv": conv, "conv_bias": d_raw.sum(0), "hidden": pooled.T @ d_hidden + 1e-5 * p["hidden"],
        "hidden_bias": d_hidden.sum(0), "out": both.T @ error + 1e-5 * p["out"], "out_bias": error.sum(),
    }


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Network:
    """A network from labels (doc_id, quality) of documents that aren't held out."""
    sample = pinned(labelled_sample(documents, labels, "quality", rows))
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    base = float(np.clip(0.5 if (rate := label_rate(labels, "quality")) is None else rate, 0.01, 0.99))
    if len(counts) < 2:
        net = initial(base)
        net["out"][:] = 0
        return Network(net)
    share = counts[1] / sum(counts.values())
    weight = {1: base / share, 0: (1 - base) / (1 - share)}

    def local(now: Parameters, batches: Iterable[pa.RecordBatch], nth: int) -> int:
        rate, seen = RATE * (1 - nth / rounds) + 0.0005, 0
        for batch in batches:
            for at in range(0, batch.num_rows, MINIBATCH):
                part = batch.slice(at, MINIBATCH)
                own = [chunks(x.encode("utf-8", "replace")) for x in part.column("text").to_pylist()]
                y = part.column("label").to_numpy().astype(np.float32)
                w = np.where(y == 1, weight[1], weight[0]).astype(np.float32)
                adam(now, gradients(now, np.concatenate(own), np.cumsum([0, *map(len, own[:-1])]), y, w), rate, FLOOR)
                seen += len(own)
        return seen

    shards = dealt(sample.select("text", "label", "h"))
    found = averaged(shards, with_moments(initial(base)), rounds, local, passes(sum(counts.values()), MINIBATCH, STEPS))
    shards.unpersist()
    return Network({k: found[k] for k in initial()})


def score_quality(documents: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(batch.column(1)).astype(float), pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_quality(documents: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, all columns, whose score reaches the threshold; scored where they are scanned, without a join."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.scores(texts).astype(float), pa.float64())

    return documents.where(score(text_or_empty()) >= threshold)
