"""lorebase: analytics over long-lived knowledge stores, as Spark plans."""
