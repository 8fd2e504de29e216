"""End-to-end jobs: ingest, features, training / scoring, analysis."""
