"""Area statistics on Spark: cleaning, enrichment, regional figures, bands, clusters, models."""
