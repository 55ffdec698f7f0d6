"""Fixture tables and the registered queries, all of them in registry.QUERIES once this package is imported."""

from quillfind.plans import catalogue, operations  # noqa: F401  they register their queries
