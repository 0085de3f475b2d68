"""Spark-native curation engine for labelled training data."""
