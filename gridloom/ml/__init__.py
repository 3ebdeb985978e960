"""Machine-learning kernels as expressions; vectors are arrays."""
