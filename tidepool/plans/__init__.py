"""A session-level interface over the operators."""
