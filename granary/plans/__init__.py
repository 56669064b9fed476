"""Named queries built from the operators, each with the SQL that must give the same rows."""
