"""lanecraft — shipment analytics as lazy Spark DataFrame plans.

Every operator is a ``DataFrame -> DataFrame`` function over the canonical
shipment columns (see :mod:`lanecraft.schema`).  Nothing in the library
collects a table to the driver; small derived tables are size-checked before
they are broadcast.
"""

__version__ = "0.1.0"
