"""Operations of a training-data pipeline, each one module; nothing else in the library imports them."""
