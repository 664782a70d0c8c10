"""Training-data operators over the ``documents``, ``pages`` and ``conversations`` tables."""
