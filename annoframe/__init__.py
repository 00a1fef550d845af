"""Spark operators that clean, measure, annotate and describe tables of speech segments."""
