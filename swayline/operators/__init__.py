"""DataFrame -> DataFrame operators: cleaning, joins, features, models, rankings."""
