"""Operators for training data made from timed text.  Nothing outside this subpackage imports it."""
