"""Event streams: machine folds, demultiplexing, rate limits, subscriptions."""
