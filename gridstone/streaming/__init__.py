"""Arrays that grow along their first axis."""
