"""Where tables and their catalog come from."""
