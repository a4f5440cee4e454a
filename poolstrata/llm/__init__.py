"""Training-data operators: one module for each, general interfaces, no import from outside this subpackage."""
