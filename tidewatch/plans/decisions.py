"""The decision chain for a set of (asset, as_of) points."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from tidewatch import settings as S
from tidewatch.operators import risk as R
from tidewatch.session import staged

SIGNALS = [f for f, _, _ in S.MARKET_SIGNALS + S.FLOW_SIGNALS + S.SENTIMENT_SIGNALS]


class Chain:
    """Panel -> percentiles -> component reports -> orchestration -> doubt -> decision.

    A decision date takes the latest row at or before it, so only those rows get
    reports. What feeds several later steps is written once.
    """

    def __init__(self, panel: DataFrame, pct: DataFrame, predictions: DataFrame, points: DataFrame,
                 analogues: DataFrame | None = None, precedents: DataFrame | None = None):
        """``panel`` and ``pct`` are read several times: pass staged tables. ``points`` holds (asset, as_of, date).
        ``analogues`` brings the best similarity, ``precedents`` the nearest one's summary, both per (asset, date)."""
        self.panel, self.pct, self.points, self.analogues, self.precedents = panel, pct, points, analogues, precedents
        keys = panel.join(points.select("asset", "date").distinct(), ["asset", "date"], "left_semi").select("asset", "date")
        out = R.models(keys, predictions)
        for component in (R.market, R.flow, R.sentiment):
            out = out.unionByName(component(keys, pct), allowMissingColumns=True)
        self.reports = staged(out, "reports")

    @cached_property
    def _preliminary(self) -> DataFrame:
        return staged(R.orchestrate(self.reports), "preliminary")

    @cached_property
    def _doubt(self) -> DataFrame:
        return staged(R.skeptic(self._preliminary, self.reports, R.context(self.panel, self.pct), self.analogues), "doubt")

    def preliminary(self) -> DataFrame:
        return self._preliminary

    def doubt(self) -> DataFrame:
        return self._doubt

    def decisions(self) -> DataFrame:
        return R.decide(self._preliminary, self._doubt)

    def drivers(self) -> DataFrame:
        return R.drivers(self.reports)

    def narratives(self) -> DataFrame:
        return R.narrative(self.decisions(), self.drivers(), self.reports, self._doubt, self.precedents)

    def at_points(self, df: DataFrame) -> DataFrame:
        """Rows per (asset, as_of) instead of per panel date."""
        return self.points.join(df, ["asset", "date"])
