"""tallyforge: a PySpark-native engine for ranking and scoring entities against a target profile.

``functions``  Column -> Column building blocks (text, URLs, dates, money, vectors)
``operators``  DataFrame -> DataFrame operators (matching, rubric, dedupe, staleness, dossier)
``sources``    readers and writers
``plans``      registered queries and their SQL counterparts
``streaming``  structured-streaming forms
``llm``        training-data operators; nothing else in the package imports it
"""
