"""Where the five levels come from: Git repositories, and snapshots of their metadata as Parquet."""
