"""Evidence-first knowledge builds as Spark DataFrame operators."""
