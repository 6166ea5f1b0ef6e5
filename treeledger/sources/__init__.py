"""Reading repository tables, checkouts and the files of earlier runs."""
