"""The 24 recipe operations, one module per family."""
