"""End-to-end entry points: file or table -> profile -> plan -> dashboard tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.profile import Profile, profile, summary
from quarry.plans.plan import Dashboard, recommend_plan, run_plan
from quarry.session import scratch_dir
from quarry.sources import sinks
from quarry.sources.delimited import Ingested, read_delimited


@dataclass
class Analysis:
    profile: Profile
    plan: dict
    dashboard: Dashboard


def auto_dashboard(df: DataFrame, selections: dict | None = None, approx: bool = False) -> Analysis:
    """A10 -> U3 -> U2 over a table: profile it, recommend a plan, run the plan."""
    prof = profile(df, approx=approx)
    plan = recommend_plan(prof.columns)
    return Analysis(prof, plan, run_plan(df, plan, selections))


def analyse_file(spark: SparkSession, path: str, out_dir: str | None = None, sep: str | None = None,
                 order_by: list[str] | None = None) -> tuple[Ingested, Analysis]:
    """The reference's whole pipeline for a delimited file: ingest, write the clean table,
    profile, plan and answer it.

    The text is parsed once: the typed table is written as Parquet (under ``out_dir``, or a
    fresh folder under the shared ``spark.checkpoint.dir``) and everything after reads that
    copy, with column pruning and pushed-down filters, and with the lineage cut at the
    write, so a lost executor never sends a later step back to the raw text. With
    ``out_dir`` the metadata, profile, summary and plan are written next to it.
    """
    ing = read_delimited(spark, path, sep=sep)
    folder = out_dir or scratch_dir(spark, "load")
    ing.metadata = sinks.write_load(spark, ing, folder)
    clean = sinks.read_clean(spark, f"{folder}/clean")
    res = auto_dashboard(clean)
    if out_dir:
        sinks.write_profile(res.profile.df, f"{out_dir}/profile")
        sinks.write_metadata(spark, summary(clean, res.profile, ing.metadata, order_by), f"{out_dir}/summary")
        sinks.write_plan(spark, res.plan, f"{out_dir}/plan")
    return Ingested(df=clean, rejects=ing.rejects, raw=ing.raw, metadata=ing.metadata), res
