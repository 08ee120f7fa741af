"""A fact database, Datalog and pull engine whose queries are Spark DataFrame plans."""
