"""Operators for large-scale training data, each with a registered query opN_<name>."""
