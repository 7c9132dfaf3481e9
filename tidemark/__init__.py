"""tidemark: event analytics and behavioural anomaly detection as Spark jobs."""
