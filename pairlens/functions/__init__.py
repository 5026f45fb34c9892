"""pairlens.functions."""
