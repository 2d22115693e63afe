"""Where series come from: the store, table views, and binary files."""
