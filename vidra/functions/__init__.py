"""Functions of the proofreading engine."""
