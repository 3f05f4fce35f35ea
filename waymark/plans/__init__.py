"""Batch plans: build, attribution, index, views."""
