"""Operators on pairs and snapshots: load, lookup, dictionary, statistics and comparison."""
