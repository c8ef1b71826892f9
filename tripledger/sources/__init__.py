"""Readers, fixed tables, the test-table adapter and writers."""
