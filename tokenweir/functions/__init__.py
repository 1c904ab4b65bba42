"""tokenweir.functions."""
