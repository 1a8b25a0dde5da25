"""Operators for texts of training data. Nothing outside this folder imports it."""
