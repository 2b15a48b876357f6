"""Spark-first engine for Earth-observation catalogues: search, spatial joins, manifests, fetch ledgers, rasters and cubes."""
