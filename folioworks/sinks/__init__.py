"""Results written out: caches, batch files, summaries, telemetry."""
