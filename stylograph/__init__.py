"""stylograph: text forensics on Spark DataFrames."""
