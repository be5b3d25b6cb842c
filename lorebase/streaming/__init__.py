"""streaming of lorebase."""
