"""One run of a factor: formula and universe brought to form, guards, backtest, and the flags that say what stood in for what.

Counts come out of the pass that writes the guarded panel (``DataFrame.observe``), so nothing is read a second time to count it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import guards
from ..operators.backtest import backtest
from ..session import staged
from ..sources.panel import in_universe
from .compiler import compute_or_proxy
from .normalize import normalize

GUARDS = ("special", "suspended", "new_listing", "limit", "no_previous_close")


@dataclass
class RunFlags:
    """What a run did in place of what was asked. A proxy is a fallback too; ``clean`` runs had neither."""

    formula: str
    universe: str
    formula_proxy: bool = False
    formula_fallback: bool = False
    formula_fallback_reason: str = ""
    formula_rewritten: bool = False
    universe_fallback: bool = False
    universe_fallback_reason: str = ""
    rows_before: int = 0
    rows_after: int = 0
    dropped: dict[str, int] = field(default_factory=dict)

    @property
    def clean(self) -> bool:
        return not (self.formula_fallback or self.universe_fallback)


def run(panel: DataFrame, formula: str, universe: str | None = None, names: tuple[str, ...] = (), settings: guards.GuardSettings = guards.GuardSettings(), groups: int = 5, cost_bps: float = 10.0) -> tuple[DataFrame, RunFlags]:
    """The backtest's row for a formula as a report writes it, and the run's flags. ``names``: words that choose a proxy where the formula cannot run.

    The guarded panel is written once; its counts are complete when this returns, the backtest is still lazy.
    """
    asked = normalize(formula, universe, *names)
    seen = Observation("guards")
    counts = [F.count_if(F.col("dropped_by") == g).alias(g) for g in GUARDS]
    marked = guards.marked(in_universe(panel, asked.universe), settings).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("dropped_by").isNull()).alias("kept"), *counts)
    kept = staged(marked.where("dropped_by IS NULL").drop("dropped_by"), "guarded")
    found: dict = {}
    factor = compute_or_proxy(kept, asked.formula, found, strict=False)
    flags = RunFlags(
        formula=asked.formula, universe=asked.universe, formula_proxy=asked.used_proxy, formula_fallback=asked.used_proxy or bool(found.get("formula_fallback")),
        formula_fallback_reason=found.get("formula_fallback_reason", f"a stand-in for {formula!r}" if asked.used_proxy else ""), formula_rewritten=asked.mechanical_rewrite,
        universe_fallback=asked.universe_fallback, universe_fallback_reason=f"no pool is named {universe!r}" if asked.universe_fallback else "",
        rows_before=seen.get["rows"], rows_after=seen.get["kept"], dropped={g: seen.get[g] for g in GUARDS},
    )
    return backtest(factor, kept, groups, cost_bps), flags
