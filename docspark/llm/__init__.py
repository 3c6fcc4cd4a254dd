"""Operations of a training-data pipeline over a corpus table; nothing else in the library imports this subpackage."""
