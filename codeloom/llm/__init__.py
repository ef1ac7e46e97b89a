"""Operators for preparing language-model training data at scale.

Each module holds one operator with a general interface over any DataFrame;
``queries`` applies them to whole tables with production parameters.
"""
