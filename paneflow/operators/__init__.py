"""paneflow.operators."""
