"""Spark-native proofreading of Macedonian text at corpus scale."""
