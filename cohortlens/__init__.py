"""A Spark-first analytics engine for cohort studies over multichannel recordings."""
