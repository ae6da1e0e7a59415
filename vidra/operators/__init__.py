"""Operators of the proofreading engine."""
