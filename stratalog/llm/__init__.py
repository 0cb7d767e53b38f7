"""Training-data operators: ten corpus stages that the rest of the library never imports."""
