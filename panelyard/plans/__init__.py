"""How the operators reach the cluster: staging, size-checked joins, hot-group splits."""
