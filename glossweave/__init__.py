"""Corpus analytics as lazy Spark plans."""
