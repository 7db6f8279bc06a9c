"""Column-level building blocks: JVM expressions only, usable on batch and stream."""
