"""Operations of a training-data pipeline, each over DataFrames.  Nothing else in the library imports this package."""
