"""Sparkloom: code-structure analytics over content-addressed snapshots, on Spark."""

__version__ = "0.1.0"
