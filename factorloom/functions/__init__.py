"""Column functions: IEEE arithmetic, ranks, rolling frames."""
