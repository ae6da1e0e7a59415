"""Sources of the proofreading engine."""
