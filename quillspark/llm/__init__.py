"""Operators for preparing text at training-data scale. Nothing outside this folder imports it."""
