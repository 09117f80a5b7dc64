"""Stored versions of relations, change-log files, backup and restore."""
