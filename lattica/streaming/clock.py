"""A stateful source of operations: numbers what authors send with author_seq and Lamport time as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructType

#: The store that Spark keeps the state of transformWithState in; set as ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AuthorClock(StatefulProcessor):
    """Per author how many operations it has made, and its Lamport time."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle) -> None:
        self.state = handle.getValueState("clock", "made long, lamport long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("arrived", kind="stable")  # what one trigger brings of an author
        made, lamport = self.state.get() if self.state.exists() else (0, 0)
        numbered = []
        for seen in batch["lamport_ts"]:
            if pd.isna(seen):
                made, lamport = made + 1, lamport + 1
                numbered.append((made, lamport))
            else:
                lamport = max(lamport, int(seen))
                numbered.append((None, None))
        self.state.update((made, lamport))
        out = batch[self.columns].assign(author_seq=[n for n, _ in numbered], lamport_ts=[t for _, t in numbered])
        yield out[out["author_seq"].notna()]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.state.update((int(row["max_seq"]), int(row["lamport_ts"])))

    def close(self) -> None:
        pass


def assigned(requests: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The streaming twin of :func:`lattica.operators.oplog.assigned`: author_seq and lamport_ts by state per author.

    ``requests`` (author, arrived, lamport_ts, ...) are a stream; ``log`` is a table, whose version vector and clock a
    new query begins with. The state is kept with the query's checkpoint, so a query that is started again goes on
    gapless, and a batch that runs again gives the same numbers. Authors without an own operation in the log begin at 0.
    """
    from lattica.operators import oplog

    columns = [c for c in requests.columns if c != "lamport_ts"]
    schema = StructType([requests.schema[c] for c in columns]).add("author_seq", LongType()).add("lamport_ts", LongType())
    start = None
    if log is not None:
        start = oplog.version_vector(log).join(oplog.lamport_clock(log)).groupBy("author")  # one row
    return requests.groupBy("author").transformWithStateInPandas(
        statefulProcessor=AuthorClock(columns), outputStructType=schema, outputMode="Append", timeMode="None", initialState=start
    )
