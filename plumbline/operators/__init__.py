"""Operators over DataFrames: execution, contracts, comparison, scoring, lineage graphs, routing, provenance, memory."""
