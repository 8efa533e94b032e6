"""Writers for books, manifests, feeds, logs and tokens."""
