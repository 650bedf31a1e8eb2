"""foresail: time-series forecasting, evaluation and preparation as Spark DataFrame programs."""
