"""Place-based service-provider analytics on PySpark."""
