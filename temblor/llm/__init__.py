"""Operations for training-data pipelines over whole text tables."""
