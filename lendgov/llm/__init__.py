"""Operators for training-data pipelines over documents, conversations and embeddings.

Each module holds one operator as plain functions on DataFrames; ``queries``
registers one thin query per operator. Nothing else in the library imports this
package.
"""
