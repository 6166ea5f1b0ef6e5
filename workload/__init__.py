"""The driver's tables seen as repositories and runs, with one query per operator and its SQL counterpart."""
