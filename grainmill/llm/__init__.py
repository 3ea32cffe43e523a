"""Operators on texts and labels for training-data work.  Nothing outside this subpackage imports it."""
