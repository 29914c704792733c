"""Registered queries over the driver's tables: the adapter, the stage tables, and the catalogs."""
