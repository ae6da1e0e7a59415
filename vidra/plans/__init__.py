"""Plans of the proofreading engine."""
