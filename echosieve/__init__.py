"""echosieve: text-repetition analytics and corpus preparation as Spark DataFrame plans."""
