"""The queries over the driver's tables, each beside SQL that gives the same rows."""
