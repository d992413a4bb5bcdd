"""Fixture views and multi-operator pipelines."""
