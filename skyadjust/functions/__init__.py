"""Column expressions and kernels: cameras, map projection, polygons, robust losses."""
