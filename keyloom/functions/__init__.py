"""Keyloom subpackage."""
