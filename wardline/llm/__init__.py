"""Operators of a training-data pipeline over the text tables.

Nothing else in the library imports this subpackage; the driver's entry
module adds its queries only when it can be imported.
"""
