"""Named queries over the star schema's tables, each with the SQL that gives the same rows."""
