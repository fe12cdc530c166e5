"""Scalar functions: Column in, Column out, all within Catalyst."""
