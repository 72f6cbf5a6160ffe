"""Tables from files, folders and databases."""
