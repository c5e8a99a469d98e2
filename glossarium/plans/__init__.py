"""Views that queries start from."""
