"""pairlens.sources."""
