"""Writing run tables and manifests."""
