"""Applying a growing change log."""
