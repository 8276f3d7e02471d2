"""Operations of a training-data pipeline for language models."""
