"""fluxloom: biosphere carbon-flux analytics as Spark DataFrame operators."""
