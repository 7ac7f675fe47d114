"""Whole analyses, composed of operators."""
