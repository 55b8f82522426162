"""nightledger: observation-session analytics as Spark DataFrame operators."""
