"""Message sources and sinks."""
