"""DataFrame operators: indicators, rules, ledgers, metrics, statistics."""
