"""Subpackage streaming of ledgerloom."""
