"""facetflow: a Spark-first engine for surface meshes and corpus tables.

A mesh is a handful of relations keyed by ``mesh_id``; every operator is a
DataFrame plan, and only inherently sequential kernels run as grouped Arrow
functions.
"""

__version__ = "0.1.0"
