"""Work on whole groups (a page, a table) where order and state rule out plain expressions."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starts(batch: pa.Table, by: Sequence[str]) -> list[int]:
    """First rows of the runs of equal keys."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in by:
        column = batch.column(name).combine_chunks()
        missing = column.is_null().to_numpy(zero_copy_only=False)
        values = column.drop_null().to_numpy(zero_copy_only=False) if not missing.any() else np.where(missing, None, np.array(column.to_pylist(), object))
        new[1:] |= (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    return np.flatnonzero(new).tolist()


def map_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], work: Callable[[pa.Table], dict], columns: str) -> DataFrame:
    """The rows that `work` makes of each group: a dict of equally long columns from a group's table, sorted by `order`.

    columns: names and types of what work returns; the keys are added in front. One shuffle on the keys; a task holds
    a batch and the group that reaches over its end, and handles thousands of small groups in one call. Tasks are as many
    as shuffles have: few bytes can be much work, so they aren't joined by size.
    """
    keys = list(by)
    names = [c.split()[0] for c in _split(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            starts = _starts(part, keys)
            if len(starts) > 1:
                yield from made(part, starts[:-1], starts[-1])
            rest = part.slice(starts[-1])
        if rest is not None:
            yield from made(rest, [0], rest.num_rows)

    def made(part: pa.Table, starts: list[int], end: int) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in [*keys, *names]}
        heads = {k: part.column(k).take(pa.array(starts)).to_pylist() for k in keys}
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], end], strict=True)):
            rows = work(part.slice(a, b - a))
            size = len(rows[names[0]])
            for k in keys:
                out[k] += [heads[k][n]] * size
            for c in names:
                out[c].extend(rows[c])
        yield pa.RecordBatch.from_pydict({c: pa.array(out[c], kinds[c]) for c in out})

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), columns])
    kinds = {f.name: _arrow(f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def met(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join of relations that both grow with the documents: sorted and merged, never broadcast.

    Files of narrow rows compress so well that Spark takes them for small; broadcast, all their rows pass through the driver.
    """
    return left.join(right.hint("merge"), list(on), how)


def _split(columns: str) -> list[str]:
    """Column definitions at the commas outside angle brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
