"""Projections of relational tables onto graphs, and iteration plans."""
