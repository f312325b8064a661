"""DataFrame operators: cleaning, filters, aggregates, series, text, features, models, metrics."""
