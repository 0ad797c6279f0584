"""Fact tables, snapshots and linearisation."""
