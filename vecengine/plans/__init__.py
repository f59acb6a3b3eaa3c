"""Physical choices: ranges, sizes and the catalog of queries."""
