"""tidewake: a typed analytics engine on PySpark."""
