"""Relational, retrieval, graph and timeline operators on DataFrames."""
