"""Evaluate model responses over large question/response tables with Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here collects rows to the driver.
"""
