"""cladeflow: Spark-native analytics for hierarchical checklists and text corpora."""
