"""Workloads that put operators, functions and kernels together."""
