"""tabulon: a Spark-native analytics engine for sheets, document search and corpus upkeep."""
