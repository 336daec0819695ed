"""Options of a store; names and defaults are fixed values of the format."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.errors import InvalidConfiguration

KB, MB = 1 << 10, 1 << 20
MAX_KEY, MAX_VALUE = 8 * KB, 1024 * MB


@dataclass(frozen=True)
class Options:
    """``sync_mode``: always, interval (``sync_interval`` seconds), bytes (``sync_bytes``) or none.  ``paranoid_checks``
    verifies page checksums on reading.  Accepted without effect, since Spark or the file system decides:
    max_write_buffers (a flush is synchronous), block_size, block_based_bloom_filter, the slowdown and stop triggers,
    max_background_* (one thread, see ``Store.start_compaction``), max_wal_size, recycle_wal_files, transaction_timeout."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    paranoid_checks: bool = False
    max_memtable_size: int = 64 * MB
    max_write_buffers: int = 3
    block_size: int = 4 * KB
    compression: str = "none"
    bloom_filter_bits_per_key: int = 10
    block_based_bloom_filter: bool = True
    l0_compaction_trigger: int = 4
    l0_slowdown_trigger: int = 8
    l0_stop_trigger: int = 12
    max_bytes_for_level_base: int = 256 * MB
    max_bytes_for_level_multiplier: int = 10
    target_file_size_base: int = 64 * MB
    target_file_size_multiplier: int = 1
    max_background_compactions: int = 4
    max_background_flushes: int = 2
    block_cache_size: int = 256 * MB
    enable_table_cache: bool = True
    max_open_files: int = 1000
    sync_mode: str = "interval"
    sync_interval: float = 0.1
    sync_bytes: int = MB
    max_wal_size: int = 128 * MB
    recycle_wal_files: bool = True
    max_transactions: int = 1000
    transaction_timeout: float | None = 60.0
    max_key_size: int = MAX_KEY
    max_value_size: int = MAX_VALUE
    detect_write_conflicts: bool = False

    def validate(self) -> "Options":
        rules = {
            "max_memtable_size must be at least 1 KB": self.max_memtable_size >= KB,
            "block_size must be at least 256": self.block_size >= 256,
            "l0 triggers must be ordered compaction <= slowdown <= stop": self.l0_compaction_trigger <= self.l0_slowdown_trigger <= self.l0_stop_trigger,
            "max_write_buffers must be at least 2": self.max_write_buffers >= 2,
            "sync_interval and sync_bytes must be positive": self.sync_interval > 0 and self.sync_bytes > 0,
            "max_key_size must be at most 8 KB": self.max_key_size <= MAX_KEY,
            "compression must be none, lz4 or snappy": self.compression in ("none", "lz4", "snappy"),
            "sync_mode must be always, interval, bytes or none": self.sync_mode in ("always", "interval", "bytes", "none"),
        }
        for what, ok in rules.items():
            if not ok:
                raise InvalidConfiguration(what)
        return self

    def max_bytes_for_level(self, level: int) -> int:
        if level == 0:
            return self.max_memtable_size * self.l0_compaction_trigger
        return self.max_bytes_for_level_base * self.max_bytes_for_level_multiplier ** (level - 1)

    def target_file_size_for_level(self, level: int) -> int:
        return self.target_file_size_base * self.target_file_size_multiplier**level
