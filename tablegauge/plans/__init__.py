"""Whole assessments composed from the operators."""
