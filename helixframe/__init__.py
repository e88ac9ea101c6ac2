"""Single-cell sequencing analytics as Spark jobs: reads, barcodes, UMIs, counts, quality, clustering, validation."""
