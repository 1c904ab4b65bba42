"""tokenweir.streaming."""
