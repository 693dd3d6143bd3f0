"""Scalar functions: native column expressions, and numpy kernels over pixels."""
