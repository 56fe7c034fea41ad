"""tabwright: tabular analysis as Spark DataFrame operators."""
