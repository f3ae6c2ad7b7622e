"""Runnable queries over the test tables."""
