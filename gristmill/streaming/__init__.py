"""Time-driven checks as Structured Streaming jobs, with batch twins."""
