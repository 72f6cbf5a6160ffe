"""Operators on keyed, time-ordered tables."""
