"""DataFrame to DataFrame building blocks with columns and thresholds as parameters."""
