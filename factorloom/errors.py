"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class FormulaError(EngineError, ValueError):
    """A factor formula that cannot be read or compiled."""


class UnsafeFormulaError(FormulaError):
    """A formula with constructs outside the formula language."""


class PanelError(EngineError, ValueError):
    """A panel without the columns or the keys that an operation needs."""
