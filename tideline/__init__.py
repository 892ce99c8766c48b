"""tideline: time-aware document ranking and analytics as Spark DataFrame plans."""
