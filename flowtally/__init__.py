"""Packet-flow fairness analytics as PySpark jobs."""
