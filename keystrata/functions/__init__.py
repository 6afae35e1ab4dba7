"""Predicate functions and the expression language that names them."""
