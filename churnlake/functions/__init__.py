"""Column-level functions and binning (FE1-FE3); all native
Spark expressions, no Python UDFs."""
