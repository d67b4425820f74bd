"""The running game of each library, kept as state while commands stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passages.streaming.jobs import run_to_log

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "library_id string, seq bigint, game_id bigint"


class RunningGame(StatefulProcessor):
    """Of each library the last start, and when each game was last halted (stopped or archived).

    Commands may come in any order: an older start never replaces a newer one, and a halt that comes
    before its start is remembered for it. At most one game runs, the last one started.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.started = handle.getValueState("started", "seq bigint, game_id bigint")
        self.halted = handle.getMapState("halted", "game_id bigint", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started = tuple(self.started.get()) if self.started.exists() else None
        halts: dict[int, int] = {}
        for batch in rows:
            starts = batch[batch["kind"] == "start"]
            if len(starts):
                last = starts.loc[starts["seq"].idxmax()]
                found = (int(last["seq"]), int(last["game_id"]))
                started = found if started is None else max(started, found)
            ends = batch[batch["kind"].isin(["stop", "archive"])]
            for game, seq in ends.groupby("game_id")["seq"].max().items():
                halts[int(game)] = max(int(seq), halts.get(int(game), int(seq)))
        for game, seq in halts.items():
            before = self.halted.getValue((game,))[0] if self.halted.containsKey((game,)) else seq
            self.halted.updateValue((game,), (max(seq, before),))
        running = None
        if started is not None:
            self.started.update(started)
            game = (started[1],)
            over = self.halted.containsKey(game) and self.halted.getValue(game)[0] > started[0]
            running = None if over else started[1]
        seq = started[0] if started else None
        yield pd.DataFrame({"library_id": [key[0]], "seq": pd.array([seq], "Int64"), "game_id": pd.array([running], "Int64")})

    def close(self) -> None:
        pass


def running_log(commands: DataFrame, log: str) -> DataFrame:
    """Running game (library_id, seq, game_id) of every library that a batch of commands touches.

    ``commands`` is (library_id, game_id, seq, kind). ``game_id`` is null while no game runs. Libraries
    are spread over the tasks; a restart goes on from the state of the checkpoint.
    """
    spark = commands.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        states = commands.groupBy("library_id").transformWithStateInPandas(
            statefulProcessor=RunningGame(), outputStructType=OUT, outputMode="Update", timeMode="None"
        )
        return run_to_log(states, log, "update")
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
