"""Analytics over gridded sensor imagery, detections and site tracks on Spark DataFrames."""
