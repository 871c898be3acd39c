"""Settings of the engine, their presets, and what they mean for Spark's writers and sessions."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30

#: What each preset changes of the defaults below.
PRESETS: dict[str, dict] = {
    "default": {},
    "development": {"mem_table_size": MB, "value_log_file_size": 10 * MB, "num_compactors": 1, "compression": "none", "block_cache_size": 16 * MB},
    "production": {"mem_table_size": 128 * MB, "value_log_file_size": 2 * GB, "num_compactors": 8, "sync_writes": True, "block_cache_size": 512 * MB},
    "high_performance": {"mem_table_size": 256 * MB, "value_log_file_size": 4 * GB, "num_compactors": 16, "block_cache_size": GB, "table_cache_size": 256 * MB},
    "memory_optimized": {"mem_table_size": 16 * MB, "value_log_file_size": 256 * MB, "num_compactors": 2, "sync_writes": True, "compression_level": 9, "block_cache_size": 32 * MB, "table_cache_size": 16 * MB, "filter_cache_size": 8 * MB, "metrics": False},
}


@dataclass(frozen=True)
class Options:
    """Defaults are fixed values; `replace` gives a changed copy, `problems` says what is wrong with it."""

    mem_table_size: int = 64 * MB
    num_memtables: int = 5
    max_levels: int = 7
    level_size_multiplier: int = 10
    base_table_size: int = 2 * MB
    num_compactors: int = 4
    num_level_zero_tables: int = 5
    compaction_strategy: str = "level"
    value_threshold: int = MB
    value_log_file_size: int = GB
    block_size: int = 4 * KB
    bloom_false_positive: float = 0.01
    bloom_expected_items: int = 10_000
    compression: str = "zlib"
    compression_level: int = 6
    sync_writes: bool = False
    detect_conflicts: bool = True
    max_read_keys: int = 10_000
    max_write_keys: int = 1_000
    read_ahead_size: int = 64 * KB
    write_buffer_size: int = MB
    block_cache_size: int = 256 * MB
    table_cache_size: int = 64 * MB
    filter_cache_size: int = 32 * MB
    cache_shards: int = 16
    metrics: bool = True

    @classmethod
    def preset(cls, name: str = "default") -> Options:
        return cls(**PRESETS[name])

    def replace(self, **changes) -> Options:
        return dataclasses.replace(self, **changes)

    def problems(self) -> list[str]:
        """Every rule that the settings break; an empty list is a valid configuration."""
        positive = [f.name for f in dataclasses.fields(self) if f.type == "int" and f.name != "compression_level" and getattr(self, f.name) <= 0]
        rules = {
            "bloom_false_positive must lie between 0 and 1": 0 < self.bloom_false_positive < 1,
            "level_size_multiplier must be at least 2": self.level_size_multiplier >= 2,
            "compression must be none or zlib": self.compression in ("none", "zlib"),
            "compression_level must be 1 to 9": 1 <= self.compression_level <= 9,
            "compaction_strategy must be level, size_tiered or universal": self.compaction_strategy in ("level", "size_tiered", "universal"),
            "a value log file must hold a separated value": self.value_log_file_size > self.value_threshold,
        }
        return [f"{n} must be above 0" for n in positive] + [text for text, holds in rules.items() if not holds]

    def level_budget(self, level: int) -> int:
        return min(self.base_table_size * self.level_size_multiplier**level, 2**63 - 1)

    def cache_memory(self) -> int:
        return self.block_cache_size + self.table_cache_size + self.filter_cache_size

    def summary(self) -> dict[str, int | bool]:
        memtables = self.mem_table_size * self.num_memtables
        return {
            "cache_memory": self.cache_memory(),
            "memtable_memory": memtables,
            "estimated_memory": self.cache_memory() + memtables + self.write_buffer_size + self.read_ahead_size,
            "bloom_bytes": int(-self.bloom_expected_items * math.log(self.bloom_false_positive) / math.log(2) ** 2 / 8),
            "largest_level": self.level_budget(self.max_levels - 1),
            "for_high_concurrency": self.num_compactors >= 4 and self.cache_shards >= 8 and self.max_read_keys >= 1000 and self.max_write_keys >= 100,
            "for_large_data": self.mem_table_size >= 64 * MB and self.value_log_file_size >= GB and self.block_cache_size >= 256 * MB and self.max_levels >= 5,
            "compressed": self.compression != "none",
        }

    def writer_options(self, key: str = "k") -> dict[str, str]:
        """For df.write.options(...): codec, row-group size, Bloom filter on the key."""
        codec = "uncompressed" if self.compression == "none" else "gzip"
        return {"compression": codec, "parquet.block.size": str(self.mem_table_size), f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.fpp#{key}": str(self.bloom_false_positive)}
