"""Column functions: text of values, templates, keys, images, JSON answers."""
