"""Row-wise operators on a streaming table."""
