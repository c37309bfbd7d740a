"""Sources and sinks: table scans, CSV/Parquet writes, HTML and JSON payloads."""
