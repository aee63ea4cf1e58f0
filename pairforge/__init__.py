"""pairforge: similarity joins as DataFrame plans."""
