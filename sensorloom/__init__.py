"""sensorloom: perception annotation analytics as Spark DataFrame jobs."""
