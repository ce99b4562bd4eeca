"""weftwork: dialogue curation, grounding and evaluation as plain Spark DataFrame operators."""
