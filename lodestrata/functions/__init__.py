"""Subpackage of lodestrata."""
