"""Relational operators: joins on ranges and suffixes, ordered bag difference, islands, matching, ranking."""
