"""evisift: document collections to searchable, auditable evidence, on PySpark."""
