"""quarry: a Spark-native table profiler and dashboard-query engine.

A delimited file or table goes in; out come a cleaned, typed DataFrame, a per-column
profile, a dashboard plan (filters, KPI formulas, charts) and the aggregate tables that
answer it. Every step is a lazy DataFrame/Column expression planned by Catalyst; the
driver only sees small things: a sniffed header, per-column evidence, filter bounds,
option lists and the plan itself.
"""

from quarry.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
