"""wordloom: a Spark-native text-corpus, vocabulary and token-vector engine.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a ``Column``
expression) so callers chain them with ``DataFrame.transform`` and Catalyst
plans the whole chain at once.
"""

__version__ = "0.1.0"
