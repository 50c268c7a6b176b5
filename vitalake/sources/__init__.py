"""Table registry, readers and sinks."""
