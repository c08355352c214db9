"""Named queries and table-to-table operators. Each returns a DataFrame."""
