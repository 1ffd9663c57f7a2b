"""Spark-native clinical cohort analytics."""
