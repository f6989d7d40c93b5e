"""Column builders; all native expressions unless a docstring says otherwise."""
