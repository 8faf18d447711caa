"""The queries that the driver runs, each with the SQL that must give the same rows."""
