"""numpy kernels that run inside grouped pandas functions."""
