"""All queries of the core by name."""

from shelfmark.plans import catalogue, objects, problems

QUERIES = {**catalogue.QUERIES, **objects.QUERIES, **problems.QUERIES}
