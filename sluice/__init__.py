"""A Spark engine for adaptive, budget-aware queries."""
