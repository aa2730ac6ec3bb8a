"""Training-data operators. Nothing else in marketframe imports this subpackage."""
