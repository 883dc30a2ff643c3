"""Scalar functions of the store as Column builders."""
