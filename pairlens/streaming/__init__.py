"""pairlens.streaming."""
