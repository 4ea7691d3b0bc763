"""Subpackage sources of ledgerloom."""
