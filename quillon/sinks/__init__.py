"""Writers: index tables, manifests and bundles."""
