"""Training-data operators over the ``documents`` table. Nothing else in the library imports this package."""
