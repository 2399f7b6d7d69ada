"""Named queries over the catalogue tables, and SQL that gives the same results."""
