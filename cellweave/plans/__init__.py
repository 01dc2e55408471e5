"""Registered queries: each plan module pairs a Spark query with its ANSI SQL."""

from cellweave.plans.registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES", "register"]
