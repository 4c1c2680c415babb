"""Hierarchical classification results on Spark: combine, decode, score, report."""
