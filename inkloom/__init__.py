"""inkloom: data processing for transcriptions and text recognition, on Spark DataFrames."""
