"""Operators: staging, intermediate models, monthly signals and rule classifiers."""
