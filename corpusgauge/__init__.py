"""Corpus quality engine on Spark: text tables in, findings and scores out."""
