"""The registered queries: inputs derived from the test tables, and their SQL oracles."""
