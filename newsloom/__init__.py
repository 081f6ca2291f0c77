"""Newsroom analytics on Spark: discovery gates, versioned corpora, receipts, clusters and dossiers."""
