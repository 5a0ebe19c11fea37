"""Fitting a model on executors: SHARDS parts of a bounded sample are passed over at the same time, each from the
same parameters, and what comes out is averaged, round after round.

The driver gets the parameters of each shard, never rows: its memory is bounded by the model. The shards and the
order in them follow from a hash of doc_id, so a fit gives the same model on any cluster.
"""

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 8
Parameters = dict[str, np.ndarray]


def dealt(sample: DataFrame) -> DataFrame:
    """A sample (..., h) in its shards, persisted (to be unpersisted by the caller); a lost part is made again.

    In a shard, rows are in the order of another hash: by h itself, which the sample was chosen by, the rows of the
    label that has more of them would come first.
    """
    mixed = sample.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(SHARDS))).withColumn("nth", F.xxhash64("h", F.lit(1)))
    return mixed.repartition(SHARDS, "shard").sortWithinPartitions("nth").drop("shard", "nth").persist(StorageLevel.MEMORY_AND_DISK)


def passes(rows: int, minibatch: int, steps: int) -> int:
    """How often a round passes over its shard, so that a round has about `steps` steps, whatever the sample's size."""
    return max(1, round(steps * SHARDS * minibatch / max(1, rows)))


def averaged(sample: DataFrame, start: Parameters, rounds: int, local: Callable[[Parameters, Iterable[pa.RecordBatch], int], int], times: int = 1) -> Parameters:
    """`start` after `rounds` rounds; local(parameters, batches, round) changes the parameters in a pass and returns the rows passed."""
    now = start
    for k in range(rounds):
        given = now

        def run(batches: Iterator[pa.RecordBatch], given=given, k=k) -> Iterator[pa.RecordBatch]:
            found, n = {name: x.copy() for name, x in given.items()}, 0
            again = [*batches] if times > 1 else batches  # a sample that is passed over again is a small one
            for _ in range(times):
                n = local(found, again, k)
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "found": [pickle.dumps(found)]}, pa.schema([("n", pa.int64()), ("found", pa.binary())]))

        parts = [(r.n, pickle.loads(r.found)) for r in sample.mapInArrow(run, "n long, found binary").collect()]
        total = sum(n for n, _ in parts)
        now = {name: np.array(sum(n * p[name].astype(float) for n, p in parts) / total, x.dtype) for name, x in given.items()}
    return now


def adam(now: Parameters, gradients: Parameters, rate: float, floor: float) -> None:
    """One step, in place; now also holds the step and the means of gradients (m.) and of their squares (v.). Gradients well
    below `floor` move little."""
    now["step"] += 1
    step = float(now["step"])
    for name, g in gradients.items():
        m, v = now[f"m.{name}"], now[f"v.{name}"]
        m[...] = 0.9 * m + 0.1 * g
        v[...] = 0.99 * v + 0.01 * g * g
        now[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + floor)).astype(now[name].dtype)


def with_moments(parameters: Parameters) -> Parameters:
    zeros = {f"{k}.{name}": np.zeros_like(x) for k in "mv" for name, x in parameters.items()}
    return parameters | zeros | {"step": np.zeros((), float)}
