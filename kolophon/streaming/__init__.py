"""Nothing here: every input is a static table, so there is no streaming operator to offer."""
