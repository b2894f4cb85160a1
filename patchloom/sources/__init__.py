"""Readers of tables and of unified diffs and coverage reports."""
