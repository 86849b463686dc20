"""Tessella: a PySpark-native engine for knowledge-base, retrieval and training-data workloads."""
