"""Building blocks over DataFrames."""
