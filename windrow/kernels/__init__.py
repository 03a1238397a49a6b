"""Numeric kernels that run inside tasks on Arrow batches."""
