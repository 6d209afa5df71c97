"""Text-semantics analytics on Spark: dictionaries, rules, references, task graphs and verdicts as DataFrame plans."""
