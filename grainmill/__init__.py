"""grainmill: DataFrame operators that prepare language-model training data on Spark."""
