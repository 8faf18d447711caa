"""One module for each family of operators; all take and return columns or frames."""
