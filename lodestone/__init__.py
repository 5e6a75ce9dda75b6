"""Spark jobs for text archives: corpus building, retrieval, evidence, activity and live tallies."""
