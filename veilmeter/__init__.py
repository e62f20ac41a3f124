"""Veilmeter: privacy-leakage auditing of machine-learning models as Spark jobs."""
