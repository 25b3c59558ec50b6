"""Column builders: no row loops, everything stays inside the JVM."""
