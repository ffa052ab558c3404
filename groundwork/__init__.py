"""Groundwork: a PySpark-native engine for corpus ingestion, retrieval, grounding audits and log analytics."""
