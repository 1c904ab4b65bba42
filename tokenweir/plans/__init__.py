"""tokenweir.plans."""
