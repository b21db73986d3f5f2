"""A Spark-native security-log lake: table-to-table and stream-to-table jobs."""
