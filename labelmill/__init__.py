"""labelmill: build, profile, clean, balance, featurise and score labelled-text tables on Spark."""
