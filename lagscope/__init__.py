"""Consumer-lag and cluster-health analytics as composable PySpark DataFrame operators."""
