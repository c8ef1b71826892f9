"""Whole jobs composed of operators and models."""
