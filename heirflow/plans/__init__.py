"""Whole runs, stand-in inputs, the query catalog and its SQL twins."""
