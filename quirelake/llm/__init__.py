"""Operators for preparing large text collections; nothing outside this package imports it."""
