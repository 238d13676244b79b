"""Building blocks shared by the operators: row order and staged tables."""
