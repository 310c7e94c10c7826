"""Clickloom: recommendation and clickstream analytics as Spark jobs over tables and streams."""
