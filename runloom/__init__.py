"""Agent-trace analytics on PySpark: typed events, run state, anomalies, episodes and views."""
