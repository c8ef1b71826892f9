"""DataFrame operators: roll-up, allowance, encoding, ranks, windows, scaling."""
