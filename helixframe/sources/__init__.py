"""Readers of sequencing files, matrices, whitelists and manifests, and a generator of synthetic samples."""
