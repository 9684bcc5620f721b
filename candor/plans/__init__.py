"""The whole of truth discovery, and the queries that the driver runs."""
