"""Compositions of operators: preparation, generation, and the registered queries."""
