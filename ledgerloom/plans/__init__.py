"""Subpackage plans of ledgerloom."""
