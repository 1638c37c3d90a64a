"""The forward filter as a stream: state (m, c, loglik) per model, carried between batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def filter_stream(sums: DataFrame, parameters: dict[str, dict[str, float]]) -> DataFrame:
    """model, t, m, c, loglik for every time step that arrives, in order of t within a batch.

    sums(model, t, n, s, q) are the step sums of the batch filter; parameters holds g, w, v, m0
    and c0 of each model.  A time step at or before the state's last one is late and is left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        p = parameters[key[0]]
        m, c, ll, last = state.get if state.exists else (p["m0"], p["c0"], 0.0, -(2**62))
        out = []
        for row in pd.concat(list(frames)).sort_values("t").itertuples():
            if row.t <= last:
                continue
            m, c, last = p["g"] * m, p["g"] ** 2 * c + p["w"], int(row.t)
            if row.n > 0:
                spread, e = p["v"] + row.n * c, row.s - row.n * m
                ee = row.q - 2 * m * row.s + row.n * m * m
                ll -= 0.5 * (row.n * np.log(2 * np.pi) + (row.n - 1) * np.log(p["v"]) + np.log(spread) + (ee - c * e * e / spread) / p["v"])
                m, c = m + c * e / spread, c * p["v"] / spread
            out.append((key[0], last, m, c, ll))
        state.update((m, c, ll, last))
        yield pd.DataFrame(out, columns=["model", "t", "m", "c", "loglik"])

    return sums.groupBy("model").applyInPandasWithState(run, "model string, t long, m double, c double, loglik double", "m double, c double, loglik double, last long", "append", "NoTimeout")
