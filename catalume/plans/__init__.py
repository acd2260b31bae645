"""Predicate compiler, query builder and the JSON query languages."""
