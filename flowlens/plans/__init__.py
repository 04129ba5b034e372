"""Named queries over the driver tables, each with the SQL that it is checked against."""
