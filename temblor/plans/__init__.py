"""Named queries and their SQL; ``registry()`` has all of them."""
