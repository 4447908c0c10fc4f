"""Filling windows of fixed capacity with documents, each window in the wanted proportions of sources.

Deficit round-robin over a queue for each source: at every window a source earns its share of the capacity, and the source
that is owed most gives one of its next documents, of about the size it is owed. Near the end of a window the document that
closes it best is taken. Deficits are carried from window to window, so over any stretch of windows every source comes within
about a window of its share.

Tasks pack blocks of bounded size, each a random part of all documents. Windows that stay open although a document could
still fit are packed again, from blocks that mix what several tasks left over, with the deficits of all windows closed so
far. The number of such rounds is fixed and no task ever gets more than a block.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tokens import DEFAULT_TOKENIZER, normal_source, token_counts
from nearfield.session import persist_table

PIECES = "doc_id long, piece int, token_start long, n_tokens long, source string"
ROWS = "window_id long, slot int, " + PIECES
#: Sources with a queue of their own; further ones share the queue of those without a share.
MAX_SOURCES = 1024


class Queue:
    """The items of a source in their order and by size."""

    def __init__(self):
        self.order: deque[int] = deque()
        self.sizes: list[int] = []
        self.items: dict[int, list[int]] = {}

    def add(self, size: int, item: int) -> None:
        if size not in self.items:
            insort(self.sizes, size)
            self.items[size] = []
        self.items[size].append(item)
        self.order.append(item)

    def largest(self, room: int) -> int:
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int, item: int | None = None) -> int:
        same = self.items[size]
        if item is None:
            item = same.pop()
        else:
            same.remove(item)
        if not same:
            del self.items[size]
            self.sizes.remove(size)
        return item

    def front(self, used: list[bool], n: int) -> list[int]:
        """The next n items that are still there."""
        while self.order and used[self.order[0]]:
            self.order.popleft()
        out = []
        for i in self.order:
            if not used[i]:
                out.append(i)
                if len(out) == n:
                    break
        return out


def pack_windows(sizes: np.ndarray, sources: np.ndarray, capacity: int, shares: np.ndarray, deficits: np.ndarray, look: int = 4) -> list[list[int]]:
    """Windows as lists of item numbers; every item of size 1 to capacity is placed once. deficits is updated.

    look: among so many next items of a source the one nearest to what it is owed is taken.
    """
    queues = [Queue() for _ in shares]
    size, used = np.asarray(sizes).tolist(), [False] * len(sizes)
    of = np.asarray(sources).tolist()
    for i in np.random.default_rng(7).permutation(len(size)).tolist():  # large ones mustn't wait for the end
        queues[of[i]].add(size[i], i)
    earn, owed = (shares * capacity).tolist(), deficits.tolist()
    left, windows, names = len(size), [], range(len(queues))
    # from here on a further item would leave a gap that few can fill
    closing = max(capacity // 16, min(sum(size) // max(left, 1), capacity // 2))
    while left:
        for s in names:
            owed[s] += earn[s]
        room, window = capacity, []
        while room and left:
            got = None
            if room > closing:
                for s in sorted((s for s in names if owed[s] > 0 and queues[s].sizes), key=lambda s: -owed[s]):
                    fit = [i for i in queues[s].front(used, look) if size[i] <= room and size[i] <= 2 * owed[s]]
                    if fit:
                        got = s, min(fit, key=lambda i: abs(size[i] - owed[s]))
                        break
            if got is None:
                # nothing is due: what closes the window best, the more so if it is owed
                fits = {s: n for s in names if (n := queues[s].largest(room))}
                if not fits:
                    break
                s = max(fits, key=lambda s: fits[s] + max(min(owed[s], fits[s]), -capacity) / 4)
                got = s, queues[s].items[fits[s]][-1]
            s, i = got
            queues[s].take(size[i], i)
            used[i] = True
            window.append(i)
            owed[s] -= size[i]
            room -= size[i]
            left -= 1
        windows.append(window)
    deficits[:] = owed
    return windows


def packed_windows(docs: DataFrame, capacity: int = 2_048, shares: dict[str, float] | None = None, tokenizer_path: str = DEFAULT_TOKENIZER, block_rows: int = 16_384, full: float = 0.98, rounds: int = 3) -> DataFrame:
    """window_id, slot, doc_id, piece, token_start, n_tokens, source: every token of every document in one window.

    docs: doc_id, text, source; other columns are ignored. A document of more than `capacity` tokens is cut into pieces of
    the capacity and a rest; all others stay whole. Null and empty texts have no token and no row. A repeated row is placed
    as often as it occurs. shares: the wanted token share of each (normalised) source in a window; by default the shares
    the documents have, so that all windows mirror them. Sources without a share, null ones too, share what is left over;
    so do those beyond the MAX_SOURCES largest.

    A window is closed if it is `full` or no piece of the collection is small enough for its room. After `rounds` further
    packings of what the others hold, all are closed.
    """
    counted = persist_table(token_counts(docs.withColumn("source", normal_source("source")), tokenizer_path).filter("n_tokens > 0"), "token-counts")
    start = F.col("piece").cast("long") * capacity
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / capacity) - 1).cast("int"))))
    pieces = pieces.select("doc_id", "piece", start.alias("token_start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("long").alias("n_tokens"), "source")
    rest = F.pmod(F.col("n_tokens"), F.lit(capacity))
    by_source = counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.ceil(F.col("n_tokens") / capacity)).alias("n"), F.min(F.when(rest > 0, rest).otherwise(capacity)).alias("least"))
    everything = by_source.agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.min("least").alias("least")).first()
    if shares is None:
        largest = by_source.filter("source IS NOT NULL").orderBy(F.desc("t"), "source").limit(MAX_SOURCES).collect()
        shares = {r.source: r.t / everything.t for r in largest}
    names = sorted(shares)
    number = {s: i for i, s in enumerate(names)}
    share = np.array([shares[s] for s in names] + [max(0.0, 1 - sum(shares.values()))])
    smallest = everything.least or 1

    def pack(level: int, last: bool, deficits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = list(batches)
            if not sum(b.num_rows for b in got):
                return
            t = pa.Table.from_batches(got).combine_chunks()
            size = t["n_tokens"].to_numpy()
            code = t["source"].combine_chunks().dictionary_encode(null_encoding="encode")
            of = np.array([number.get(s, len(names)) for s in code.dictionary.to_pylist()], int)
            windows = pack_windows(size, of[code.indices.to_numpy()], capacity, share, deficits.copy())
            item = np.array([i for w in windows for i in w])
            n = np.array([len(w) for w in windows])
            first = np.cumsum(n) - n
            fill = np.add.reduceat(size[item], first)
            done = last | (fill >= full * capacity) | (capacity - fill < smallest)
            # the parts of an id: round, task, window of the task
            ids = (level << 24 | TaskContext.get().partitionId()) << 32 | np.arange(len(n))
            out = t.select([c.split()[0] for c in PIECES.split(", ")]).take(pa.array(item))
            out = out.add_column(0, "slot", pa.array((np.arange(len(item)) - np.repeat(first, n)).astype(np.int32)))
            out = out.add_column(0, "window_id", pa.array(np.repeat(np.where(done, ids, -1), n)))
            yield from out.combine_chunks().to_batches(max_chunksize=8192)

        return run

    todo, n_todo, closed = pieces, everything.n or 0, None
    deficits = np.zeros(len(share))
    for level in range(rounds + 1):
        n_tasks = -(-n_todo // block_rows) or 1
        # round robin: each task gets a part of what every other held
        rows = persist_table(todo.repartition(n_tasks).mapInArrow(pack(level, level == rounds or n_tasks == 1, deficits / n_tasks), ROWS), f"packed-{level}")
        done = rows.filter("window_id >= 0")
        closed = done if closed is None else closed.unionByName(done)
        todo = rows.filter("window_id < 0").drop("window_id", "slot")
        n_todo = todo.count()
        if not n_todo:
            break
        # what the windows closed so far owe to each source
        placed = {r.source: (r.t, r.w) for r in closed.withColumn("source", F.when(F.col("source").isin(names), F.col("source"))).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum((F.col("slot") == 0).cast("long")).alias("w")).collect()}
        deficits = share * capacity * sum(w for _, w in placed.values()) - np.array([placed.get(s, (0, 0))[0] for s in [*names, None]])
    return closed


def window_report(windows: DataFrame) -> DataFrame:
    """source, n_tokens, share, n_windows, mean_gap: how far a window's share of the source lies from the source's overall
    share, on average over all windows, those without the source included. A null source is a source."""
    per = windows.groupBy("window_id", "source").agg(F.sum("n_tokens").alias("t"))
    size = windows.groupBy("window_id").agg(F.sum("n_tokens").alias("size"))
    total = size.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).first()
    share = per.groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_windows")).withColumn("share", F.col("n_tokens") / F.lit(total.t or 1))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    share = share.withColumn("k", key)
    seen = per.withColumn("k", key).join(size, "window_id").join(share.select("k", F.col("share").alias("s")), "k").groupBy("k").agg(F.sum(F.abs(F.col("t") / F.col("size") - F.col("s"))).alias("gap"))
    return share.join(seen, "k").select("source", "n_tokens", "share", "n_windows", ((F.col("gap") + (F.lit(total.n) - F.col("n_windows")) * F.col("share")) / F.lit(total.n or 1)).alias("mean_gap"))
