"""Build the whole model (M01-M10) with materialised reuse points.

``unified_events`` feeds nine views and ``unified_sessions`` feeds the four
user rollups; each is written once as a table in the shared checkpoint folder
so the dedupe and session shuffles run once per model build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from trailmark.config import ModelConfig
from trailmark.plans.events import unified_events
from trailmark.plans.metrics import pv_engaged_time, pv_scroll_depth, screen_summary_metrics
from trailmark.plans.sessions import unified_sessions
from trailmark.plans.users import unified_users, unified_users_aggs, unified_users_lasts, unified_users_sessions
from trailmark.plans.views import unified_views
from trailmark.session import materialize


class UnifiedModel:
    """Lazily built model tables; ``events`` and ``sessions`` are materialised on first use."""

    def __init__(self, atomic: DataFrame, cfg: ModelConfig, dims: dict[str, DataFrame],
                 materialized: bool = True, with_model_tstamp: bool = True):
        self.atomic, self.cfg, self.dims = atomic, cfg, dims
        self.materialized, self.with_model_tstamp = materialized, with_model_tstamp
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def events(self) -> DataFrame:
        def build():
            ev = unified_events(self.atomic, self.cfg)
            return materialize(ev, "unified_events") if self.materialized else ev
        return self._get("events", build)

    @property
    def screen_summary_metrics(self) -> DataFrame:
        return self._get("ssm", lambda: screen_summary_metrics(self.events))

    @property
    def pv_engaged_time(self) -> DataFrame:
        return self._get("eng", lambda: pv_engaged_time(self.events, self.cfg, self.screen_summary_metrics))

    @property
    def pv_scroll_depth(self) -> DataFrame:
        return self._get("scroll", lambda: pv_scroll_depth(self.events, self.screen_summary_metrics))

    @property
    def views(self) -> DataFrame:
        return self._get("views", lambda: unified_views(self.events, self.cfg, self.pv_engaged_time,
                                                        self.pv_scroll_depth, self.with_model_tstamp))

    @property
    def sessions(self) -> DataFrame:
        def build():
            s = unified_sessions(self.events, self.cfg, self.dims, self.with_model_tstamp)
            return materialize(s, "unified_sessions") if self.materialized else s
        return self._get("sessions", build)

    @property
    def users_sessions(self) -> DataFrame:
        return self._get("us", lambda: unified_users_sessions(self.sessions))

    @property
    def users_aggs(self) -> DataFrame:
        return self._get("ua", lambda: unified_users_aggs(self.users_sessions))

    @property
    def users_lasts(self) -> DataFrame:
        return self._get("ul", lambda: unified_users_lasts(self.users_sessions, self.users_aggs))

    @property
    def users(self) -> DataFrame:
        return self._get("users", lambda: unified_users(self.users_sessions, self.users_aggs, self.users_lasts,
                                                        self.with_model_tstamp))
