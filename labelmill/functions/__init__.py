"""Column functions: expressions that stay inside the JVM and need no shuffle."""
