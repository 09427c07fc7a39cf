"""peakloom: array-valued scientific records (spectra) on Spark DataFrames."""
