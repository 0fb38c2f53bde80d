"""Operators for preparing training text: archives, licences, fingerprints, duplicates, mixing, packing, classifiers, chat.

Nothing else in the library imports this subpackage. Each module has one operator with a general interface; the
registered queries are in ``sheetlens.llm.registry``.
"""
