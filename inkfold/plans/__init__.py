"""Named queries over the test tables, each with the same query in DuckDB SQL where SQL can express it."""
