"""Index tables, query workloads and experiments."""
