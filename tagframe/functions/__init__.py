"""Column expressions (JVM-side, code-generated where Spark allows)."""
