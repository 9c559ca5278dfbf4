"""Named queries: operators over the driver tables, each with the SQL it must equal."""
