"""What a store can raise; ``recoverable`` errors may succeed on a retry, ``corrupt`` ones mean damaged files."""


class StoreError(Exception):
    recoverable = False
    corrupt = False


def _kind(name: str, doc: str, **flags) -> type[StoreError]:
    return type(name, (StoreError,), {"__doc__": doc, "__module__": __name__, **flags})


IoError = _kind("IoError", "The file system failed.")
Corruption = _kind("Corruption", "A file's content contradicts itself.", corrupt=True)
CrcMismatch = _kind("CrcMismatch", "A checksum differs.", corrupt=True)
InvalidFormat = _kind("InvalidFormat", "Bytes do not decode.", corrupt=True)
IncompleteRecord = _kind("IncompleteRecord", "A record ends early.")
NotFound = _kind("NotFound", "A file or entry is missing.")
AlreadyExists = _kind("AlreadyExists", "A file exists already.")
LockError = _kind("LockError", "The lock file can't be used.")
DatabaseLocked = _kind("DatabaseLocked", "Another process has the store open.")
DatabaseClosed = _kind("DatabaseClosed", "The store is closed.")
DatabaseExists = _kind("DatabaseExists", "error_if_exists is set and the store exists.")
DatabaseNotFound = _kind("DatabaseNotFound", "create_if_missing is off and there is no store.")
InvalidConfiguration = _kind("InvalidConfiguration", "Options contradict each other or a level is out of range.")
KeyTooLarge = _kind("KeyTooLarge", "A key exceeds max_key_size.")
ValueTooLarge = _kind("ValueTooLarge", "A value exceeds max_value_size.")
EmptyKey = _kind("EmptyKey", "An empty key where none is allowed; the store itself allows it.")
WriteBufferFull = _kind("WriteBufferFull", "Too much is waiting to be flushed.", recoverable=True)
TooManyOpenFiles = _kind("TooManyOpenFiles", "max_open_files is reached.", recoverable=True)
TooManyTransactions = _kind("TooManyTransactions", "max_transactions are active.", recoverable=True)
TransactionConflict = _kind("TransactionConflict", "A key was written since the transaction's snapshot.", recoverable=True)
TransactionAborted = _kind("TransactionAborted", "The transaction is no longer active.", recoverable=True)
ManifestError = _kind("ManifestError", "The manifest can't be read or published.")
CompactionError = _kind("CompactionError", "A compaction failed.")
IteratorError = _kind("IteratorError", "A cursor is not on an entry.")
Internal = _kind("Internal", "A bug.")
