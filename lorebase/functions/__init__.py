"""functions of lorebase."""
