"""Registered queries: importing the package fills `catalogue.QUERIES` and `catalogue.ORACLES`."""

from memloom.plans import catalogue, chunks, rules

__all__ = ["catalogue", "chunks", "rules"]
