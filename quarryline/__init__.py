"""A repository-analytics engine on Spark: five relational levels, typed verbs, content functions and Git sources."""
