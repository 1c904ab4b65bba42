"""tokenweir.sources."""
