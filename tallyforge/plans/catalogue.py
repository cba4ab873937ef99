"""All registered queries outside the corpus operators, and their SQL counterparts."""

from __future__ import annotations

from tallyforge.plans import candidates, dossier, evidence, layout, matching, profile, search, signals, stores, tables, text, vectors

BOOKS = [vectors.book, matching.book, text.book, signals.book, tables.book, dossier.book, layout.book, profile.book, evidence.book, candidates.book, search.book, stores.book]
QUERIES = {name: f for b in BOOKS for name, f in b.queries.items()}
ORACLE_SQL = {name: s for b in BOOKS for name, s in b.sql.items()}
