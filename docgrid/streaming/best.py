"""The best score so far of each run, over evaluation outputs as they arrive."""

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docgrid.functions.coords import score_in

#: Keyed state of any kind needs this state store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Best(StatefulProcessor):
    """Keeps a run's best iteration, its score and the number of scores seen; tells each batch in which a run's best changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "iteration long, score double, n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.best.get() if self.best.exists() else None
        iteration, score, n = held if held is not None else (None, None, 0)
        before = iteration
        for row in rows:
            n += 1
            # ties go to the first iteration, in whatever order rows arrive
            if score is None or (row["score"], -row["iteration"]) > (score, -iteration):
                iteration, score = row["iteration"], row["score"]
        self.best.update((iteration, score, n))
        if iteration != before:
            yield Row(run=key[0], iteration=iteration, score=score, n=n)

    def close(self) -> None:
        pass


def best_so_far(outputs: DataFrame, name: str = "hmean") -> DataFrame:
    """(run, iteration, score, n) whenever a run's best changes; outputs: a stream (run, iteration, output) of texts that hold `"name": score`.

    n counts the run's scores until then. Outputs without a score are left out. State is a row for each run.
    """
    session = outputs.sparkSession
    if session.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = outputs.schema["run"].dataType.simpleString()
    scored = outputs.select("run", F.col("iteration").cast("long").alias("iteration"), score_in(F.col("output"), name).alias("score")).where("score IS NOT NULL AND iteration IS NOT NULL")
    return scored.groupBy("run").transformWithState(Best(), f"run {kind}, iteration long, score double, n long", "Update", "None")
