"""Operators on records and vectors, each a composition of DataFrame operations."""
