"""Spelling variants: the words of a corpus grouped by single edits, each under the most frequent word near it.

Words are counted in every text. The vocabulary, in order, is cut into shards of at most ``shard_words`` words and ``SHARD_CHARS``
characters (or one word), and a task makes each a compact trie: nodes by depth, then in order, so that one sorted array of (parent, character)
is the whole tree and a child is found by binary search. Shards are broadcast ``group_bytes`` at a time (or one), whatever the vocabulary's
size; for each group every word's automaton for distance one meets every shard. The walk follows all words of a block down their own path;
at each step it leaves the path by a replaced, an inserted or a deleted character, and what has left it goes exactly, to its
end, before the path goes on. An edit is made only where a word and its neighbour first differ, so that no neighbour is met twice.
Each word's neighbours are counted, and the most frequent one kept, in the task; what a word has from several groups is added up by shuffle.

Characters are those of ``RUN``, one byte each (Latin-1). Roots come from forms by doubling steps; a form is at least twice as frequent as
its word, so that there are no cycles and at most six steps or so.

Defined results: null and empty texts have no words; a null id counts as an empty one in the hash that deletes characters; runs of any length are
words; repeated rows count each; equal numbers go to the word that sorts first; an empty table, or no word frequent enough, gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut, returning, shuffle_tasks, small

RUN = "[A-Za-zÀ-ÿ]+"
SHARD_WORDS = 1 << 17
SHARD_CHARS = 1 << 21
GROUP_BYTES = 1 << 25
#: Words counted in a task before they are handed on, and their characters.
HELD, HELD_CHARS = 1 << 18, 1 << 23
#: Words walked at once.
BLOCK = 2048


def count_words(documents: DataFrame, shortest: int, delete_one_in: int) -> DataFrame:
    """(word, n) of the runs of whole texts in small letters, of at least ``shortest`` characters.

    A run whose hash with its document's id ``delete_one_in`` divides loses one character: noise that puts variants into clean texts (0: none).
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, chars = re.compile(RUN).findall, {}, 0
        for b in batches:
            for name, text in zip(b.column(0), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{name.as_py()}:".encode())
                # In UTF-8 lower() changes A-Z alone.
                for word, n in Counter(find(text.as_py().encode().lower().decode())).items():
                    if len(word) < shortest:
                        continue
                    if delete_one_in:
                        h = zlib.crc32(word.encode(), seed)
                        if h % delete_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    chars += 0 if word in held else len(word)
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD or chars > HELD_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held, chars = {}, 0
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return rows.mapInArrow(returning(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Sorted words. Node 0 is the root, node k the k-th smallest (parent << 8 | character); ``word`` is the index of the word that ends at a node, or -1."""

    def __init__(self, keys: np.ndarray, word: np.ndarray, text: bytes, ends: np.ndarray, n: np.ndarray) -> None:
        self.keys, self.word, self.text, self.ends, self.n = keys, word, text, ends, n
        self.first = np.searchsorted(keys >> 8, np.arange(len(keys) + 2)) + 1

    @classmethod
    def of(cls, words: list[str], n: list[int]) -> Trie:
        data = [w.encode("latin-1") for w in words]
        text = b"".join(data)
        size = np.array(list(map(len, data)), dtype=np.int64)
        ends = np.append(0, np.cumsum(size))
        chars = np.frombuffer(text, dtype=np.uint8)
        live, parent, made, keys = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), 0, []
        word = [np.full(1, -1, dtype=np.int64)]
        for depth in range(int(size.max(initial=0))):
            key = parent << 8 | chars[ends[live] + depth]
            fresh = np.append(True, key[1:] != key[:-1])
            keys.append(key[fresh])
            parent = made + np.cumsum(fresh)
            ended = size[live] == depth + 1
            last = np.full(int(fresh.sum()), -1, dtype=np.int64)
            last[parent[ended] - made - 1] = live[ended]
            word.append(last)
            made += len(last)
            live, parent = live[~ended], parent[~ended]
        return cls(np.concatenate(keys) if keys else np.empty(0, np.int64), np.concatenate(word), text, ends, np.array(n, dtype=np.int64))

    def arrays(self) -> list[bytes]:
        return [self.keys.tobytes(), self.word.astype(np.int32).tobytes(), self.text, self.ends.tobytes(), self.n.tobytes()]

    @classmethod
    def read(cls, keys: bytes, word: bytes, text: bytes, ends: bytes, n: bytes) -> Trie:
        return cls(np.frombuffer(keys, np.int64), np.frombuffer(word, np.int32), text, np.frombuffer(ends, np.int64), np.frombuffer(n, np.int64))

    def spelled(self, i: int) -> str:
        return self.text[self.ends[i] : self.ends[i + 1]].decode("latin-1")

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by a character, or -1."""
        key = node << 8 | char
        at = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        return np.where(found, at + 1, -1)

    def near(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for every word at distance one of a query. A query is ``size`` characters of ``chars`` from ``start`` on; ``chars`` ends with one more."""
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def accept(q: np.ndarray, node: np.ndarray) -> None:
            word = self.word[node]
            if (word >= 0).any():
                found.append((q[word >= 0], word[word >= 0]))

        def exactly(q: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
            """From the nodes on the rest of the queries and nothing else."""
            while len(q):
                over = at == size[q]
                accept(q[over], node[over])
                q, node, at = q[~over], node[~over], at[~over]
                node = self.child(node, chars[start[q] + at])
                q, node, at = q[node >= 0], node[node >= 0], at[node >= 0] + 1

        q, node, depth = np.arange(len(start)), np.zeros(len(start), dtype=np.int64), 0
        while len(q):
            inside, here = depth < size[q], chars[start[q] + np.minimum(depth, size[q])].astype(np.int64)
            # Without the query's own character.
            final = depth + 1 == size[q]
            accept(q[final], node[final])
            skip = (depth + 1 < size[q]) & (chars[start[q] + np.minimum(depth + 1, size[q])] != here)
            exactly(q[skip], node[skip], np.full(int(skip.sum()), depth + 1))
            # All children.
            width = self.first[node + 1] - self.first[node]
            owner = np.repeat(np.arange(len(q)), width)
            child = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.first[node], width)
            own = inside[owner] & ((self.keys[child - 1] & 255) == here[owner]) if len(child) else np.empty(0, bool)
            off, other = owner[~own], child[~own]
            exactly(q[off], other, np.full(len(off), depth))  # one more character than the query has
            within = inside[off]
            exactly(q[off[within]], other[within], np.full(int(within.sum()), depth + 1))  # another one than the query has
            q, node, depth = q[owner[own]], child[own], depth + 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]).astype(np.int64)


def trie_shards(words: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """Tries of the words, which are sorted within partitions: (task, shard, bytes, and the arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, held, n, chars = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            arrays = Trie.of(held, n).arrays()
            values = [[task], [done], [sum(map(len, arrays))], *[[x] for x in arrays]]
            kinds = [pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["task", "shard", "bytes", "keys", "word", "text", "ends", "n"])

        for b in batches:
            for word, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (len(held) >= most or chars + len(word) > SHARD_CHARS):
                    yield shard()
                    done, held, n, chars = done + 1, [], [], 0
                held.append(word)
                n.append(count)
                chars += len(word)
        if held:
            yield shard()

    return words.select("word", "n").mapInArrow(returning(run), "task long, shard long, bytes long, keys binary, word binary, text binary, ends binary, n binary")


def _near_group(words: DataFrame, shards: Broadcast) -> DataFrame:
    """(word, n_near, form_n, form): what each word has from the shards of one group, if anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.read(*x) for x in shards.value]
        for b in batches:
            every = b.column(0).to_pylist()
            for a in range(0, len(every), BLOCK):
                some = every[a : a + BLOCK]
                data = [w.encode("latin-1") for w in some]
                chars, size = np.frombuffer(b"".join(data) + b"\0", dtype=np.uint8), np.array(list(map(len, data)), dtype=np.int64)
                count, most, form = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), [""] * len(some)
                for trie in tries:
                    q, near = trie.near(chars, np.cumsum(size) - size, size)
                    if not len(q):
                        continue
                    count += np.bincount(q, minlength=len(some))
                    order = np.lexsort((near, -trie.n[near], q))
                    best = order[np.append(True, q[order][1:] != q[order][:-1])]
                    for i, w in zip(q[best].tolist(), near[best].tolist(), strict=True):
                        if (n := int(trie.n[w])) >= most[i] and (n > most[i] or trie.spelled(w) < form[i]):
                            most[i], form[i] = n, trie.spelled(w)
                has = np.flatnonzero(count).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([some[i] for i in has], pa.string()), pa.array(count[has], pa.int64()), pa.array(most[has], pa.int64()), pa.array([form[i] for i in has], pa.string())], ["word", "n_near", "form_n", "form"])

    return words.select("word").mapInArrow(returning(run), "word string, n_near long, form_n long, form string")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(word, n_near, form_n, form) of every word of a sorted vocabulary (word, n) that has another at distance one; form is the most frequent of those, then the first."""
    spark = words.sparkSession
    shards = cut(trie_shards(words, shard_words))
    groups: list[list[tuple[int, int]]] = []
    room = 0
    for task, shard, size in shards.select("task", "shard", "bytes").orderBy("task", "shard").collect():  # a row for each shard
        if not groups or size > room:
            groups.append([])
            room = group_bytes
        groups[-1].append((task, shard))
        room -= size
    parts = []
    for group in groups:
        wanted: Column = reduce(lambda x, y: x | y, [(F.col("task") == t) & (F.col("shard") == s) for t, s in group])
        tries = [[bytes(x) for x in r] for r in shards.where(wanted).orderBy("task", "shard").select("keys", "word", "text", "ends", "n").collect()]  # GROUP_BYTES, or one shard
        sent = spark.sparkContext.broadcast(tries)
        parts.append(cut(_near_group(words, sent)))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    if len(parts) == 1:
        return parts[0]
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    added = reduce(DataFrame.union, parts).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return added.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that following forms leads to."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = small(now.select(F.col("word").alias("root"), F.col("root").alias("_ahead")))
        further = cut(now.join(ahead, "root", "left").select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")))
        moved = not further.where("_moved").isEmpty()
        now = further.drop("_moved")
        if not moved:
            return now


def variants(documents: DataFrame, shortest: int = 5, least: int = 3, times: int = 2, delete_one_in: int = 0, shard_words: int = SHARD_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least ``shortest`` characters and ``least`` occurrences.

    A word's form is the most frequent word at distance one, if that is at least ``times`` (2 or more) as frequent.
    """
    if times < 2:
        raise ValueError("times must be 2 or more: forms could lead back")
    spark = documents.sparkSession
    counted = count_words(documents, shortest, delete_one_in).where(F.col("n") >= least)
    words = cut(counted.repartitionByRange(shuffle_tasks(spark), "word").sortWithinPartitions("word"))
    near = near_words(words, shard_words, group_bytes)
    whole = words.join(near, "word", "left")
    has = F.col("form_n") >= times * F.col("n")
    whole = cut(whole.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")))
    return whole.join(small(roots(whole.where("form is not null"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
