"""vecloom: vector collections as Spark tables.

Every public function takes DataFrames and returns DataFrames.  Points live in one row per id: an
``id`` string, a ``dense`` array of floats, a ``sparse`` struct of indices and values, and any number
of payload columns.
"""
