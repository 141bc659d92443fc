"""PySpark-native analytics over distributed-trace spans: anti-patterns, energy and carbon."""
