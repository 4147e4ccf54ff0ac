"""paneflow.sources."""
