"""sources of lorebase."""
