"""wardline — set-based Spark jobs over a hospital data model.

Every job takes a mapping of table name -> DataFrame (see
``wardline.sources.schemas``) plus typed parameters and returns a lazy
DataFrame. Nothing is collected to the driver.
"""

__version__ = "0.1.0"
