"""folio: text preparation and session analytics on Spark DataFrames."""
