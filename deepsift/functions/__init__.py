"""Column expressions: qualities, error models and exact tests. All of them run inside the JVM."""
