"""Registered queries: a Spark plan each, and SQL that must give the same rows."""
