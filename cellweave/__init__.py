"""Spatial-omics, knowledge-graph and rollout analytics as PySpark DataFrame operators."""
