"""paneflow.streaming."""
