"""Verdigris: documentation retrieval and evidence analytics as Spark plans."""
