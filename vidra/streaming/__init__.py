"""Streaming of the proofreading engine."""
