"""Behaviour slices, evidence, hypergraphs and evaluation as Spark jobs."""
