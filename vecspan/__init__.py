"""vecspan: vector, scored-pair and time-interval analytics as lazy Spark DataFrame operators."""
