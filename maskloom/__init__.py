"""Reversible masking of personal data in large text collections, on Spark."""
