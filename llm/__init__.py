"""Operators for preparing training data; each lives in a module of its own."""
