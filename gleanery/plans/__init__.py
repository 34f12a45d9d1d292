"""Named queries, each with SQL that checks it."""
