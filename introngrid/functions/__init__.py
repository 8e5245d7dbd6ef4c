"""Windows, intervals and tail functions that operators share."""
