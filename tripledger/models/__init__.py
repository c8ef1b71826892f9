"""The two forecasters and their bundle."""
