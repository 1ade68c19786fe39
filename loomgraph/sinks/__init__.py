"""Writers: the tables of a scan, graphs, soft edges, reports."""
