"""Spark-native operators for instrument data: frames, pulses, samples, coefficients, payloads."""
