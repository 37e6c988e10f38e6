"""Cohort assembly, risk scoring and evaluation as Spark plans."""
