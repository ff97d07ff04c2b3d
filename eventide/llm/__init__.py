"""Operators for preparing training corpora.

Each module holds one operator as functions from DataFrames to a DataFrame;
``queries`` registers them on the driver tables. Nothing outside this folder
imports it.
"""
