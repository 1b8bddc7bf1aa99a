"""Operators for training text: splitting, repair, leakage, mixing and shared spans."""
