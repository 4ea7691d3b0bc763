"""Subpackage operators of ledgerloom."""
