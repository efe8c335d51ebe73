"""The smoothed rate of each series, kept as a stream goes on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import smoothed


class _Rates(StatefulProcessor):
    """A series' state is its rate, time, bytes and largest total: it doesn't grow."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "ema double, t double, d double, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["t", "d"], kind="stable")
        state, total = None, None
        if self.state.exists():
            ema, t, d, total = self.state.get()
            state = (ema, t, d)
        for t, d, all_ in zip(batch["t"].tolist(), batch["d"].tolist(), batch["total"].tolist()):
            state = smoothed(state, t, d)
            total = all_ if total is None else max(total, all_)
        self.state.update((*state, total))
        rate = state[0] or 0.0
        eta = (total - state[2]) / rate if rate > 1 else None
        yield pd.DataFrame({"series": [key[0]], "rate": [rate], "eta": pd.Series([eta], dtype="float64")})

    def close(self) -> None:
        pass


def rates(rows: DataFrame, by: str, at: str, done: str, total: str) -> DataFrame:
    """series (text), rate, eta: after each micro-batch, the figures of the series that had rows in it (output mode update).

    rows: a stream.  The rows of a batch are taken in order of time; a row of a later batch that is older than those before counts as one at
    the same time.  Rows without a time or bytes are passed over.
    """
    kept = rows.select(F.col(by).cast("string").alias("series"), F.col(at).cast("double").alias("t"), F.col(done).cast("double").alias("d"), F.col(total).cast("double").alias("total"))
    return kept.where("t is not null and d is not null and total is not null").groupBy("series").transformWithStateInPandas(_Rates(), "series string, rate double, eta double", "Update", "None")
