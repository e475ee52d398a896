"""Standing queries over streams."""
