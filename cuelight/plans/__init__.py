"""Compositions of operators: search, feedback, hybrid ranking, sweeps."""
