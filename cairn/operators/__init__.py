"""The library's jobs: extraction, resolution, enrichment, search, graph expansion and context."""
