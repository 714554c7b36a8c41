"""A folder that pages are dropped into."""
