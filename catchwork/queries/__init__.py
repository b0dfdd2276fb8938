"""Registered queries of the engine's own operators, each beside the SQL that it must equal."""

from . import composites, geo, joins, measures, networks, overlays, rasters, relational, sites, texts, zonal

MODULES = (composites, relational, joins, sites, measures, texts, geo, networks, overlays, rasters, zonal)
