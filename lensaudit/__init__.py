"""A Spark-native engine for auditing labelled image datasets, and any table shaped like one."""
