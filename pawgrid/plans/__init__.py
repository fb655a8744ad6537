"""Composite plans and the test-table adapters."""
