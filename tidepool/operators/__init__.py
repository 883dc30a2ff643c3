"""Relational operators of the store: listing, statistics, tenancy, state, multipart, retention, trees."""
