"""pairlens.plans."""
