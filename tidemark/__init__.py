"""Tidemark: a versioned key-value and corpus analytics engine on PySpark."""

from tidemark.operators.batch import WriteBatch
from tidemark.options import Options
from tidemark.sources.store import Cursor, Snapshot, Store, Transaction

__all__ = ["Cursor", "Options", "Snapshot", "Store", "Transaction", "WriteBatch"]
