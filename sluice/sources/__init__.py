"""Driver tables, lenses, configuration snapshots and connection-driven sources."""
