"""Headwater: a PySpark-native engine for data lineage and corpus preparation."""
