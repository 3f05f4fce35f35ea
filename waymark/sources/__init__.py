"""Reading and writing tables, snapshots, GeoJSON and PBF."""
