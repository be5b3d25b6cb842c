"""operators of lorebase."""
