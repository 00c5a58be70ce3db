"""Named jobs and the queries that run every operator on the sample tables."""
