"""Composition of table functions."""
