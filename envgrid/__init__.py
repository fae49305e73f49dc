"""envgrid: Spark operators for gridded, station and polygon environmental data."""
