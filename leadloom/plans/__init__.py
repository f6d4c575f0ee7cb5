"""Query plans over the stored tables, each with the SQL that checks it."""
