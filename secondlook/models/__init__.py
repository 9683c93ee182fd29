"""Classifiers and their evaluation as table operators."""
