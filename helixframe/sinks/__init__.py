"""Writers of reads, matrices, tables and reports."""
