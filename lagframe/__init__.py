"""Delay analytics over large record corpora: sources, functions, operators and named plans on Spark DataFrames."""
