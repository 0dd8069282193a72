"""Operators for text training data: splitting, leakage, defects, labels, packing and languages."""
