"""Operators for building large training corpora on Spark."""
