"""DataFrame to DataFrame operators. Column names are arguments, so they fit ``.transform``."""
