"""Scoring over streams."""
