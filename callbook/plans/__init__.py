"""Jobs made of several operators: outcomes, scores, signals, research, strategies, portfolio, screening."""
