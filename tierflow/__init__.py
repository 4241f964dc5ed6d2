"""Analytics on logs of repeated attempts, as DataFrame transformations."""
