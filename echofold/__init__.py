"""echofold: finds what repeats on an ordered axis (frames, tokens, events, vectors) with Spark DataFrames."""
