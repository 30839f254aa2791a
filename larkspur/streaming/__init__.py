"""Event-stream operators, batch and streaming."""
