"""Stand-in tables derived from the driver's data, registered queries and their SQL twins."""
