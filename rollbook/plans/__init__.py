"""Analytic jobs composed from the operators."""
