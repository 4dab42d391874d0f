"""The domain has no streams: read files are read whole. Nothing is registered here."""
