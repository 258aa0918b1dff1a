"""Grounded question-answering dataflow and corpus preparation on Spark."""
