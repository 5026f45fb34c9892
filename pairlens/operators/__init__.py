"""pairlens.operators."""
