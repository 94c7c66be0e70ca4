"""The quota gate and the signal-change message as keyed state over a stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators.quota import STATES, gate_onward

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMPACT = 16


class StateTable:
    """Account states by micro-batch: a batch adds the accounts it moved, every COMPACT-th all accounts.

    A batch reads what earlier batches wrote and overwrites only its own folder, so repeating it after a failure, however far it came,
    gives the same state.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def before(self, batch: int) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{STATES}, whole boolean, batch bigint").parquet(self.path).where(F.col("batch") < batch)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], STATES)
        since = rows.where("whole").agg(F.max("batch").alias("b")).first()["b"]
        recent = rows.where(F.col("batch") >= (since or 0))
        return recent.groupBy("account").agg(F.max_by(F.struct("month", "state", "ts"), "batch").alias("x")).select("account", "x.*")

    def write(self, batch: int, moved: DataFrame, before: DataFrame) -> None:
        whole = batch % COMPACT == COMPACT - 1
        rows = moved.unionByName(before.join(moved.select("account"), "account", "left_anti")) if whole else moved
        rows.withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def gate_batches(requests: DataFrame, prepare: Callable[[DataFrame], DataFrame], mixes: list[list[float]], root: str, initial: int = 0) -> DataFrame:
    """Run the gate over everything the stream offers; decisions lie below `root`, by batch.

    Every micro-batch goes through the composed maps of the batch form, begun in the stored states, so an account with many
    requests is spread over tasks. `prepare` gives (account, month, ts, req_id, target_no) of a micro-batch.
    """
    def process(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        states = StateTable(batch.sparkSession, f"{root}/states")
        before = states.before(number)
        decisions, moved = gate_onward(prepare(batch), before, mixes, F.to_date("ts"), F.date_trunc("minute", "ts"), initial)
        decisions.write.mode("overwrite").parquet(f"{root}/decisions/batch={number}")
        states.write(number, moved, before)

    query = requests.writeStream.foreachBatch(process).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return requests.sparkSession.read.parquet(f"{root}/decisions").drop("batch")


def change_stream(signals: DataFrame) -> DataFrame:
    """Latest signal per account against the one before it: (account, previous, current, message)."""
    class Change(StatefulProcessor):
        def init(self, handle):
            self.prev = handle.getValueState("prev", "target string")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            pdf = pd.concat(list(rows)).sort_values(["ts", "req_id"])
            prev = self.prev.get()[0] if self.prev.exists() else None
            out = []
            for r in pdf.itertuples(index=False):
                kind = "first signal" if prev is None else "unchanged" if prev == r.target else "flipped"
                out.append((int(key[0]), int(r.req_id), prev, r.target, kind))
                prev = r.target
            self.prev.update((prev,))
            yield pd.DataFrame(out, columns=["account", "req_id", "previous", "current", "kind"])

        def close(self):
            pass

    return signals.groupBy("account").transformWithStateInPandas(
        Change(), outputStructType="account bigint, req_id bigint, previous string, current string, kind string", outputMode="append", timeMode="none")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream over everything available and append its rows to a table."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
