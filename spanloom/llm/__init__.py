"""Operators for training data at scale; nothing outside this subpackage imports it."""
