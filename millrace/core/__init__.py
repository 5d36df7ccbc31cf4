"""Session settings, scratch tables and graph helpers shared by all operators."""
