"""The same fold over a stream of mutations, keyed by chat and record."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.reducer import OUTPUT, Fold


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    own = pickle.loads(state.get[0]) if state.exists else Fold()
    rows = []
    for m in pd.concat(list(parts)).sort_values(["message", "ordinal"]).pipe(lambda d: d.astype(object).where(d.notna(), None)).to_dict("records"):
        outcome = own.apply(m)
        rows.append((m["chat"], m["record"], m["message"], m["ordinal"], m["action"], outcome, *own.fields()))
    state.update((pickle.dumps(own),))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({c: "Int64" for c in ("chat", "message", "ordinal", "created", "changed", "evaluated")})


def reduce_stream(mutations: DataFrame) -> DataFrame:
    """Outcomes as reduce_mutations() gives them, for a stream whose micro-batches come in the order of the log."""
    return mutations.groupBy("chat", "record").applyInPandasWithState(_step, OUTPUT, "fold binary", "append", GroupStateTimeout.NoTimeout)
