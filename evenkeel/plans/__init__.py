"""Class plans, grids, recipes and evaluation jobs built from the operators."""
