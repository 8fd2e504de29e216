"""Sources and sinks: trip CSVs, weather payloads, enriched tables."""
