"""Order-dependent algorithms, each run whole on one mesh (or component) at a time."""
