"""Panels from tables: reading, column names, universes, bars from ticks, fundamentals, sinks."""
