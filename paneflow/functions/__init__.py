"""paneflow.functions."""
