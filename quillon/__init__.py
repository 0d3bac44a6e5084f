"""Quillon: an analytics engine for evidence-gated selective prediction, built on Spark DataFrames."""
