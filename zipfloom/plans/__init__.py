"""Named queries and the SQL they must equal."""
