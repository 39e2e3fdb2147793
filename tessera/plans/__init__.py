"""Registered queries: operators bound to the driver's tables, each with the SQL that must give the same rows."""
