"""Analytics on events, risk and public policy, written as Spark DataFrame transformations."""
