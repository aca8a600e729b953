"""Mate pairing over a stream: the state of a name is the read that waits for its mate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "qname string, first long, second long, outcome string"
STATE = "ord long, mate int"


def _meet(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiting = state.get if state.exists else None
    out = []
    for ord_, mate in pd.concat(list(frames)).sort_values("ord")[["ord", "mate"]].itertuples(index=False):
        if waiting is None:
            waiting = (int(ord_), int(mate))
            continue
        # the same side twice drops both; either way the name is free again
        out.append((key[0], waiting[0], int(ord_), "pair" if waiting[1] != mate else "collision"))
        waiting = None
    if waiting is not None:
        state.update(waiting)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["qname", "first", "second", "outcome"])


def pair_mates(reads: DataFrame) -> DataFrame:
    """Pairs and collisions of a stream (qname, ord, mate); reads of one trigger meet in their order."""
    return reads.groupBy("qname").applyInPandasWithState(_meet, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
