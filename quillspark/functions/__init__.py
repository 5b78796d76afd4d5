"""Column functions: whitespace, normalisation, pre-tokenisation."""
