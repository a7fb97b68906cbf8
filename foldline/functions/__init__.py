"""Column functions: text, vectors and answer metrics. All JVM-side, no Python UDF."""
