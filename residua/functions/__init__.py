"""Column -> Column scalar functions (JVM-side expressions)."""
