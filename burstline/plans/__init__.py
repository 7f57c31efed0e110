"""The named queries of the library."""
