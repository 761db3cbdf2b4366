"""The catalog of trees: options, aliases, shard maps and soft deletion, in one versioned JSON document each."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans.schema import EPOCH_TICKS, MAX_INTERNAL_CHILDREN, MAX_LEAF_KEYS, SHARD_COUNT, SYSTEM_PREFIX, TICKS_PER_DAY, VIRTUAL_SLOTS
from tidelog.sources.manifest import KEPT, Files, Versioned

#: How long a deleted tree can be recovered.
SOFT_DELETE_TICKS = 3 * TICKS_PER_DAY
#: Splits that an entry remembers for diagnostics.
RECENT_SPLITS = 16


class TreeError(Exception):
    """The tree is not in a state that allows the operation."""


def now_ticks() -> int:
    return time.time_ns() // 100 + EPOCH_TICKS


@dataclass
class Entry:
    tree_id: str
    physical_id: str = ""
    max_leaf_keys: int = MAX_LEAF_KEYS
    max_internal_children: int = MAX_INTERNAL_CHILDREN
    shard_count: int = SHARD_COUNT
    map_version: int = 0
    slots: list[int] = field(default_factory=list)
    next_shard: int = 0
    publish_events: bool | None = None
    deleted_at: int = 0
    previous: dict | None = None
    recent_splits: list[list[int]] = field(default_factory=list)


def check_name(tree_id: str) -> None:
    if not tree_id or not tree_id.strip():
        raise ValueError("a tree needs a name")
    if tree_id.startswith(SYSTEM_PREFIX):
        raise ValueError(f"names that begin with {SYSTEM_PREFIX} are reserved")
    if "/" in tree_id:
        raise ValueError("a tree's name has no slash")


def check_sizes(max_leaf_keys: int, max_internal_children: int) -> None:
    if max_leaf_keys <= 1 or max_internal_children <= 2:
        raise ValueError("more than 1 key a leaf and more than 2 children a node")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _versions(self, tree_id: str) -> Versioned:
        return Versioned(self.files, f"catalog/{tree_id}")

    def find(self, tree_id: str) -> Entry | None:
        _, text = self._versions(tree_id).read()
        return Entry(**text) if text else None

    def need(self, tree_id: str, deleted: bool = False) -> Entry:
        return self._checked(tree_id, self.find(tree_id), deleted)

    def _checked(self, tree_id: str, entry: Entry | None, deleted: bool = False) -> Entry:
        if entry is None:
            raise TreeError(f"no tree {tree_id}")
        if entry.deleted_at and not deleted:
            raise TreeError(f"tree {tree_id} is deleted")
        return entry

    def update(self, tree_id: str, change: Callable[[Entry], None], deleted: bool = False) -> Entry:
        """Change an entry; of two that change it at once the later works on what the earlier left."""

        def step(now: dict | None, number: int) -> dict:
            entry = self._checked(tree_id, Entry(**now) if now else None, deleted)
            change(entry)
            return asdict(entry)

        versions = self._versions(tree_id)
        number, text = versions.commit(step)
        if number % KEPT == 0:
            versions.tidy()
        return Entry(**text)

    def register(self, tree_id: str, **options) -> Entry:
        """A new entry, or the one that is there."""
        check_name(tree_id)
        entry = self.find(tree_id)
        if entry:
            return entry
        entry = Entry(tree_id, tree_id, **options)
        check_sizes(entry.max_leaf_keys, entry.max_internal_children)
        entry.slots = [i % entry.shard_count for i in range(VIRTUAL_SLOTS)]
        entry.next_shard = entry.shard_count
        return Entry(**self._versions(tree_id).commit(lambda now, number: None if now else asdict(entry))[1])

    def exists(self, tree_id: str) -> bool:
        entry = self.find(tree_id)
        return entry is not None and not entry.deleted_at

    def ids(self) -> list[str]:
        """Names of all trees, sorted, without the reserved ones."""
        return sorted(n for n in self.files.names("catalog") if not n.startswith(SYSTEM_PREFIX))

    def set_alias(self, tree_id: str, physical: str) -> None:
        """Point a name at another tree's data: one level only."""
        if tree_id == physical:
            raise ValueError("a tree is no alias of itself")
        target = self.find(physical)
        if target is not None and target.physical_id != physical:
            raise ValueError("an alias doesn't point at an alias")
        self.update(tree_id, lambda e: setattr(e, "physical_id", physical))

    def remove_alias(self, tree_id: str) -> None:
        self.update(tree_id, lambda e: setattr(e, "physical_id", tree_id))

    def resolve(self, tree_id: str) -> str:
        entry = self.find(tree_id)
        return entry.physical_id if entry else tree_id

    def set_publish_events(self, tree_id: str, value: bool | None) -> None:
        self.update(tree_id, lambda e: setattr(e, "publish_events", value))

    def shard_map(self, tree_id: str) -> DataFrame:
        """(slot, shard) of a tree."""
        return self.spark.createDataFrame(list(enumerate(self.need(tree_id).slots)), "slot int, shard int")

    def set_shard_map(self, tree_id: str, slots: list[int]) -> int:
        """Persist a map; its version rises by one."""
        if len(slots) != VIRTUAL_SLOTS:
            raise ValueError(f"a map has {VIRTUAL_SLOTS} slots")

        def change(e: Entry) -> None:
            e.slots, e.map_version = slots, e.map_version + 1
            e.next_shard = max(e.next_shard, max(slots) + 1)
            e.shard_count = len(set(slots))

        return self.update(tree_id, change).map_version

    def allocate_shard(self, tree_id: str) -> int:
        """A shard number never used before."""
        return self.update(tree_id, self._allocate).next_shard - 1

    @staticmethod
    def _allocate(e: Entry) -> int:
        number = max(e.next_shard, max(e.slots) + 1)
        e.next_shard = number + 1
        return number

    def split_shard(self, tree_id: str, owner: int) -> int:
        """Move the upper half of a shard's slots to a new shard."""

        def change(e: Entry) -> None:
            own = [i for i, s in enumerate(e.slots) if s == owner]
            if len(own) < 2:
                raise TreeError(f"shard {owner} has fewer than 2 slots")
            new, moved = self._allocate(e), set(own[len(own) // 2 :])
            e.slots = [new if i in moved else s for i, s in enumerate(e.slots)]
            e.map_version, e.shard_count = e.map_version + 1, len(set(e.slots))
            e.recent_splits = [*e.recent_splits, [now_ticks(), owner, new]][-RECENT_SPLITS:]

        return self.update(tree_id, change).recent_splits[-1][2]

    def soft_delete(self, tree_id: str) -> None:
        self.update(tree_id, lambda e: setattr(e, "deleted_at", e.deleted_at or now_ticks()), deleted=True)

    def recover(self, tree_id: str) -> None:
        def change(e: Entry) -> None:
            if not e.deleted_at:
                raise TreeError(f"tree {tree_id} is not deleted")
            e.deleted_at = 0

        self.update(tree_id, change, deleted=True)

    def purge(self, tree_id: str) -> None:
        """Remove a deleted tree with its own data; what another name points at stays."""
        entry = self.need(tree_id, deleted=True)
        if not entry.deleted_at:
            raise TreeError(f"tree {tree_id} is not deleted")
        others = [e for t in self.ids() if t != tree_id and (e := self.find(t))]
        used = {e.physical_id for e in others} | {(e.previous or {}).get("physical_id") for e in others} | {e.tree_id for e in others}
        for physical in {tree_id, entry.physical_id, (entry.previous or {}).get("physical_id")} - used - {None}:
            self.files.delete(f"trees/{physical}")
        self.files.delete(f"catalog/{tree_id}")

    def sweep(self, now: int | None = None, after: int = SOFT_DELETE_TICKS) -> list[str]:
        """Purge the trees that were deleted longer ago than ``after``."""
        late = [t for t in self.ids() if (e := self.find(t)) and e.deleted_at and e.deleted_at + after <= (now or now_ticks())]
        for t in late:
            self.purge(t)
        return late
