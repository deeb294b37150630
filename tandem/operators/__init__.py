"""Evaluation operators: DataFrame -> DataFrame functions."""
