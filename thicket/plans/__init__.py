"""Fixed forests and query plans built from the operators."""
