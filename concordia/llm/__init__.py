"""Operators of a training-data pipeline, each a Spark job; nothing else in the library
imports this subpackage."""
