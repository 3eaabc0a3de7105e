"""Registered queries and their check SQL, one module per group of operators."""
