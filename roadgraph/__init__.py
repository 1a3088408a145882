"""Road-network resilience analytics on tables of tiles, graphs and scenarios, built from Spark DataFrame operations."""
