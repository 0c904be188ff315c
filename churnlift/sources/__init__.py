"""Sources and sinks: parquet/CSV I/O and the test-table binding."""
