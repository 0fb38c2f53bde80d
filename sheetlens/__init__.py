"""Analytics over large sets of engineering drawings, as native Spark plans.

``functions`` are column expressions, ``plans`` reusable join and fold patterns, ``sources`` readers and deterministic
views, ``operators`` the operations by subject, ``streaming`` their live forms.
"""
