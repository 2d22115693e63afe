"""Configuration, errors and the catalogue of queries."""
