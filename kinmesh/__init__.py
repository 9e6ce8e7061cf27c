"""kinmesh: a Spark-native record-linkage and entity-matching engine."""
