"""Operators over panels: the factor language, guards, backtest, metrics, robustness, review, catalogue, documents."""
