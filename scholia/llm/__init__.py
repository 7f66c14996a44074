"""Operators for building training corpora: one module each, with their queries in `queries`."""
