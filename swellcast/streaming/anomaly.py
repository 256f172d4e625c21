"""Streaming form of the anomaly state: one keyed state per (candidate, source)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from swellcast.dims import AlgorithmConfig
from swellcast.functions.numeric import decay_factor

OUTPUT_SCHEMA = (
    "candidate_id string, source_id string, date date, signal double, m double, v double, n long, "
    "anomaly double, anomaly_lag1 double, anomaly_lag2 double, late boolean"
)
STATE_SCHEMA = "m double, v double, n long, s1 double, s2 double, s3 double, day int"


class AnomalyProcessor(StatefulProcessor):
    """Advances the EWMA baseline per arriving day; days may not go back in time.

    A row older than the stored day comes out flagged ``late`` and leaves the state
    alone, so a consumer can route it to a repair job.
    """

    def __init__(self, cfg: AlgorithmConfig | None = None) -> None:
        self.cfg = cfg or AlgorithmConfig()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("anomaly", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One key's rows of one micro-batch: at most one per calendar day.
        batch = pd.concat(list(rows)).sort_values("date", kind="stable")
        m, v, n, s1, s2, s3, last = 0.0, 0.0, 0, 0.0, 0.0, 0.0, -(10**9)
        if self.state.exists():
            m, v, n, s1, s2, s3, last = self.state.get()
        out = []
        for row in batch.itertuples(index=False):
            day = (pd.Timestamp(row.date) - pd.Timestamp("1970-01-01")).days
            if day <= last:
                out.append((row.date, row.signal, m, v, n, 0.0, s1, s2, True))
                continue
            if pd.isna(row.signal):
                # A missing value holds the state, as in the batch fold; only the day moves on.
                last = day
                out.append((row.date, None, m, v, n, s1, s2, s3, False))
                continue
            p = self.cfg.params_for(row.family_primary)
            alpha, x = decay_factor(p.half_life_days), min(row.signal, self.cfg.max_x_clip)
            beta = self.cfg.beta
            sig = 0.0
            if n + 1 > p.warmup_days:
                sig = (x - max(m, beta)) / (math.sqrt(max(v, 0.0)) + beta)
            m, v, n, last = (1 - alpha) * m + alpha * x, (1 - alpha) * (v + alpha * (x - m) ** 2), n + 1, day
            s1, s2, s3 = sig, s1, s2
            out.append((row.date, row.signal, m, v, n, s1, s2, s3, False))
        self.state.update((m, v, n, s1, s2, s3, last))
        frame = pd.DataFrame(
            out, columns=["date", "signal", "m", "v", "n", "anomaly", "anomaly_lag1", "anomaly_lag2", "late"]
        )
        frame.insert(0, "source_id", key[1])
        frame.insert(0, "candidate_id", key[0])
        yield frame

    def close(self) -> None:
        pass


def anomaly_stream(daily: DataFrame, cfg: AlgorithmConfig | None = None) -> DataFrame:
    """Streaming daily signals (date, candidate, source, family, signal) to anomaly rows."""
    slim = daily.select("candidate_id", "source_id", "date", "signal", "family_primary")
    return slim.groupBy("candidate_id", "source_id").transformWithStateInPandas(
        statefulProcessor=AnomalyProcessor(cfg), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="None"
    )

