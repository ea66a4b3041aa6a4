"""Operators of a training-data pipeline (packing, chat formatting, language ID, sharding, URL
filters, HTML extraction, token files, decontamination and near-duplicate removal).

Nothing else in the library imports this subpackage; ``catalog`` registers its queries.
"""
