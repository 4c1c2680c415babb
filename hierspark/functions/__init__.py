"""Column expressions: no joins, no shuffles, all evaluated inside the JVM."""
