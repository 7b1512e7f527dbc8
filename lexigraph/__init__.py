"""Vocabulary and knowledge-graph analytics on Spark DataFrames."""
