"""Cairnlight: cohort, knowledge-graph, retrieval and evaluation operators on Spark DataFrames."""
