"""meterline: trip-record streams on Spark.

Lenient parsing of trip lines, cleaning and sorting, replay staging, hourly
event-time income (batch and Structured Streaming) and the analysis of the run
logs such streams leave behind. Every operator takes and returns DataFrames.
"""
