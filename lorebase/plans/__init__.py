"""plans of lorebase."""
