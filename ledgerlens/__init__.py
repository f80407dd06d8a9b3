"""Spark-native invoice analytics: text in, typed fields, evidence, rules and verdicts out, all as DataFrame transforms."""
