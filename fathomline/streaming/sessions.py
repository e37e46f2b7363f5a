"""Sessions as state: turns come in, summaries are due."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DUE = "session_id string, level int, covers_start int, covers_end int"
STATE = "last_turn int, covered int, first_level int, first_start int"


def summaries_due(turns: DataFrame, rounds: int = 8, keep: int = 3, merge_at: int = 4) -> DataFrame:
    """``session_id, level, covers_start, covers_end`` for each summary that falls due as turns arrive.

    A session keeps four numbers: its largest turn, the last turn that is
    summarised, and how many first-level summaries wait since which turn.
    When ``rounds`` turns are not summarised, all but the last ``keep`` are;
    after ``merge_at`` such summaries one of the second level replaces them.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, covered, waiting, start = state.get if state.exists else (0, 0, 0, 1)
        for batch in batches:
            known = batch["turn"].dropna()
            if len(known):
                last = max(last, int(known.max()))
        out = []
        if last - covered >= rounds:
            out.append((key[0], 1, covered + 1, last - keep))
            covered, waiting = last - keep, waiting + 1
            if waiting == merge_at:
                out.append((key[0], 2, start, covered))
                waiting, start = 0, covered + 1
        state.update((last, covered, waiting, start))
        yield pd.DataFrame(out, columns=["session_id", "level", "covers_start", "covers_end"])

    return (
        turns.where("session_id is not null")
        .select("session_id", "turn")
        .groupBy("session_id")
        .applyInPandasWithState(update, DUE, STATE, "append", GroupStateTimeout.NoTimeout)
    )
