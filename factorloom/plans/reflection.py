"""Bounded revision of a formula whose results deviate from what is claimed: a driver loop around Spark jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .normalize import revise


@dataclass(frozen=True)
class Attempt:
    """What was tried, and what came of it: passed, deviation score, root cause."""

    formula: str
    universe: str
    window: int | None
    passed: bool
    score: float
    cause: str


@dataclass
class Reflection:
    """``status``: converged, escalated (two attempts in a row no better than the best) or exhausted."""

    status: str = "in_progress"
    attempts: list[Attempt] = field(default_factory=list)

    @property
    def best(self) -> Attempt | None:
        return min(self.attempts, key=lambda a: a.score, default=None)


def reflect(evaluate: Callable[[str, str, int | None], tuple[bool, float, str]], formula: str, universe: str, window: int | None = None, most: int = 3) -> Reflection:
    """Evaluate, and while results deviate revise by their root cause, at most ``most`` times.

    ``evaluate`` gets formula, universe and window, and returns whether all is within tolerance, the score and the cause.
    """
    state = Reflection()
    stale = 0
    for _ in range(most):
        passed, score, cause = evaluate(formula, universe, window)
        better = state.best is None or score < state.best.score
        stale = 0 if better else stale + 1
        state.attempts.append(Attempt(formula, universe, window, passed, score, cause))
        if passed:
            state.status = "converged"
            return state
        if stale >= 2:
            state.status = "escalated"
            return state
        formula, universe, window = revise(formula, universe, cause, window)
    state.status = "exhausted"
    return state
