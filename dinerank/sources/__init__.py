"""Sources and sinks: driver-table fixtures, raw/listing scans, Parquet publish."""
