"""Event-level content analytics on Spark: normalise, recall, cluster, rank and serve, with vocabulary discovery."""
