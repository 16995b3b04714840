"""Conversation analytics on Spark DataFrames: sources, functions, operators, plans and streaming queries."""
