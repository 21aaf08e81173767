"""DataFrame operators over corpus rows."""
