"""Writers of graphs and reports."""
