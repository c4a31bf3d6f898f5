"""Operators over matrices, forests, factors and predictions."""
