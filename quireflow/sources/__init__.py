"""Where pages, layouts, dictionaries and tables come from, and where records go."""
