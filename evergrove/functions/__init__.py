"""Value semantics: ``model`` for single values, ``columns`` for Spark columns."""
