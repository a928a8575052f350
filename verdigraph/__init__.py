"""verdigraph: a PySpark-native life-cycle analytics engine."""
