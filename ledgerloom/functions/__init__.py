"""Subpackage functions of ledgerloom."""
