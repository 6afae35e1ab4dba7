"""Where tables live."""
