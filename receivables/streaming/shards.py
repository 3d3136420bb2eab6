"""States of many keys as the state of one shard, for steps of ``applyInPandasWithState``.

A call of such a step costs milliseconds (Arrow to pandas and back, column by column) whether it takes one key or a thousand, so
keys are dealt to ``SHARDS`` shards by a hash. The calls of a micro-batch are then at most ``SHARDS``, however many keys arrive;
in return a shard's states are written together. A shard's state is a compressed text with one line a key: its timer and what
is known of it, which is only decoded for keys that are asked for.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

SHARDS = 1 << 12  # part of a stream's checkpoint: a change needs a new one
STATE = "entries binary"


def shard(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


def entries(state: GroupState) -> dict[str | None, tuple[int, str]]:
    """key -> (timer, JSON of what is known) of a shard."""
    if not state.exists:
        return {}
    lines = zlib.decompress(bytes(state.get[0])).decode().split("\n")
    split = (line.split("\t", 2) for line in lines)  # JSON escapes tabs and line ends
    return {json.loads(key): (int(timer), known) for key, timer, known in split}


def keep(state: GroupState, held: dict[str | None, tuple[int, str]]) -> None:
    """Store a shard's entries, with a timer at the first of theirs."""
    if not held:
        if state.exists:
            state.remove()
        return
    text = "\n".join(f"{json.dumps(key)}\t{timer}\t{known}" for key, (timer, known) in held.items())
    state.update((zlib.compress(text.encode(), 1),))
    state.setTimeoutTimestamp(max(min(timer for timer, _ in held.values()), state.getCurrentWatermarkMs()))
