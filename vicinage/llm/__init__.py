"""Operators for the selection and cleaning of training data."""
