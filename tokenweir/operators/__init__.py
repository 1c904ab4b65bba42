"""tokenweir.operators."""
