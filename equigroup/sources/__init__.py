"""Table sources and run-log sources/sinks."""
