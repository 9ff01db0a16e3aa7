"""Training-data pipeline operators.  Nothing else in ``condmon`` imports this subpackage."""
