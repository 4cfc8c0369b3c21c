"""Readers and writers of graph documents."""
