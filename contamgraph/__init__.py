"""contamgraph: Spark-first contamination-graph analytics."""
