"""Lexicon-aware text analytics as Spark DataFrame plans."""
