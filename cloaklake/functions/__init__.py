"""Column builders: patterns, intervals, restoring, language."""
