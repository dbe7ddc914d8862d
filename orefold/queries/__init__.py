"""Named queries over a data folder, and the SQL that must agree with them."""
