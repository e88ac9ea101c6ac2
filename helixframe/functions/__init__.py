"""Column functions over sequences, qualities and barcodes."""
