"""Text-privacy analytics and corpus operators on Spark DataFrames."""
