"""Column expressions and small vectorised kernels used inside tasks."""
