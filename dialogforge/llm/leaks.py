"""Evaluation texts leaking into training text: CGK embedding, repeated bit sampling over windows and exact edit verification.

A leak is a passage of at least ``run`` words of an item (a shorter item is no leak), in the document word for word or with
up to ``edits`` words put in, left out or exchanged. Every window of ``run`` words, the size of the least leak of an item, is
embedded by CGK random walks (Chakraborty, Goldenberg, Koucky 2016): a walk copies the current word to the output at every
step and moves on or stays by a random bit of (step, word), so that windows at a small edit distance get outputs at a small
Hamming distance. Hashes of sampled places of the outputs are the LSH keys. Windows at distance 0 share all of them, so the
recall of unedited passages is 1; the number of keys (``KEYS``) and of sampled places (``SAMPLED``) is chosen for a recall
of at least 0.9 at three edits in 20 words (measured: 1 edit 1.00, 2 edits 0.99, 3 edits 0.97; the tests ask for 0.9).
Where two windows meet, the passages around them are verified by their edit distance, in a band of ``edits`` on each side.
A bound that loses none of these comes first: edits leave a passage in at most ``edits + 1`` pieces, so the longest one has
``seed_length`` words that stand in both texts side by side. Windows of the corpus with no such seed around them are not embedded.

Scale: the corpus is read once, whatever the number of items. The keys and seeds of all items make a bit table of a fixed size
(``TABLE_BITS``), the only thing that is broadcast; windows whose keys hit it are the only ones that leave the scan. They meet
the items' windows by a join on the key, salted by the document, and the verification runs on the joined rows. With so many
items that the table fills up, more windows are joined, and none is lost.

Defined results: null ids or texts and texts shorter than ``run`` words are in no result; repeated rows give one row; an
empty corpus or item table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogforge.session import cut

#: Words are runs of letters or digits in lower case; an underscore separates.
WORD = re.compile(r"[^\W_]+")
RUN, EDITS = 20, 3
#: Steps of a walk for each word of a window, walks, keys from each walk and sampled places for a key.
PACE, WALKS, KEYS, SAMPLED = 2, 3, 4, 6
#: Words around two windows that met in which their passage may begin.
SHIFT = 8
#: Size of the bit table of keys, as a power of two, and the salts of the join.
TABLE_BITS, SALTS = 26, 8
_PHI = 0x9E3779B97F4A7C15
_BATCH_WORDS, _BATCH_CHARS = 50_000, 500_000  # windows embedded, and characters of texts read, at once
_BUCKET = 32_768  # bits of a row of Spark's bitmaps
#: The bytes of ASCII text with letters in lower case and blanks between words.
_ASCII = bytes(c if chr(c).isalnum() else 32 for c in bytes(range(128)).lower()) + bytes(128)


def words_of(text: str) -> list[str]:
    if text.isascii():  # the same words without the regular expression
        return text.encode().translate(_ASCII).decode().split()
    return WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """The words of texts as one array of numbers, the numbers' hashes, and where each text begins."""

    def __init__(self, texts: list[str]) -> None:
        ids: defaultdict[str, int] = defaultdict(count().__next__)
        numbers = [list(map(ids.__getitem__, words_of(t))) for t in texts]
        self.begins = np.cumsum([0, *map(len, numbers)])
        self.words = np.fromiter(chain.from_iterable(numbers), dtype=np.int64, count=int(self.begins[-1]))
        self.vocabulary = np.fromiter(map(xxhash.xxh64_intdigest, ids), dtype=np.uint64, count=len(ids))
        self.hashes = self.vocabulary[self.words] if len(ids) else np.zeros(0, dtype=np.uint64)
        self._octets: dict[tuple[int, int], np.ndarray] = {}

    def windows(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, text) of every window of ``run`` words."""
        sizes = np.maximum(np.diff(self.begins) - run + 1, 0)
        text = np.repeat(np.arange(len(sizes)), sizes)
        return np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.begins[text], text

    def octet(self, number: int, eighth: int) -> np.ndarray:
        """For each word of the vocabulary the random bits of steps ``8 * eighth`` to ``8 * eighth + 7`` of a walk, the first one lowest."""
        if (number, eighth) not in self._octets:
            bits = np.zeros(len(self.vocabulary), dtype=np.uint8)
            for k in range(8):
                salt = np.uint64((8 * eighth + k + 1 + number * 1_000) * _PHI & 0xFFFFFFFFFFFFFFFF)
                bits |= (_mix(self.vocabulary + salt) & np.uint64(1)).astype(np.uint8) << np.uint8(k)
            self._octets[number, eighth] = bits
        return self._octets[number, eighth]


def walk(texts: Texts, starts: np.ndarray, run: int, number: int, steps: Iterable[int] | None = None) -> Iterator[np.ndarray]:
    """The place of every window's walk at each step, or those of ``steps``; ``starts + run`` once it has left its window.

    Starts and steps are in order. The steps between two wanted ones are first made from every word, side by side, so that
    the walks are moved on once for each wanted step. What leaves a window never comes back, so its end is looked at only there.
    """
    first = int(starts[0])
    words = np.append(texts.words[first : int(starts[-1]) + run], 0)
    at = starts - first
    limit = at + run
    bits: dict[int, np.ndarray] = {}  # of the steps of one eighth, for every word
    done = 0
    for step in range(PACE * run) if steps is None else steps:
        if step > done:
            for s in range(done, step):
                if s not in bits:
                    octet = texts.octet(number, s // 8)[words]
                    bits |= {k: octet >> np.uint8(k % 8) & np.uint8(1) for k in range(s, s // 8 * 8 + 8)}
            moved = bits.pop(step - 1)
            for s in range(step - 2, done - 1, -1):  # moved: words that the walk moves on in steps s to step - 1 from each word
                bit = bits.pop(s)
                moved[:-1] += bit[:-1] * (moved[1:] - moved[:-1])
                moved += bit
            at = np.minimum(at + moved.take(at), limit)
            done = step
        yield at + first


def lsh_keys(texts: Texts, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Keys (windows, WALKS * KEYS): hashes of sampled places of the walks' outputs; what lies behind a window is 0."""
    keys = np.zeros((WALKS * KEYS, len(starts)), dtype=np.uint64)
    if not len(starts):
        return keys.T
    limit, hashes = starts + run, np.append(texts.hashes, np.uint64(0))
    for number in range(WALKS):
        sampled = [np.random.default_rng((60_001, run, number, k)).choice(PACE * run, min(SAMPLED, PACE * run), replace=False).tolist() for k in range(KEYS)]
        wanted = sorted(set().union(*sampled))
        for step, at in zip(wanted, walk(texts, starts, run, number, wanted)):
            said = hashes.take(at)
            if step >= run:  # before that no walk has left its window
                np.putmask(said, at >= limit, 0)
            said *= np.uint64((step * 2 + 1) * _PHI & 0xFFFFFFFFFFFFFFFF | 1)
            for k in range(KEYS):
                if step in sampled[k]:
                    keys[number * KEYS + k] += said
    return _mix(keys.T + np.arange(1, WALKS * KEYS + 1, dtype=np.uint64) * np.uint64(_PHI))


def seed_length(run: int, edits: int) -> int:
    """Words of the longest piece that a passage keeps unedited, at least; 0, which every text has, if all words may be edited."""
    return max(0, -(-(run - edits) // (edits + 1)))


def seeds(texts: Texts, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from every place on; some of them run from one text into the next."""
    out = np.zeros(max(len(texts.words) - length + 1, 0), dtype=np.uint64)
    for k in range(length):
        out = out * np.uint64(_PHI) + texts.hashes[k : k + len(out)]
    return _mix(out)


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> np.uint64(65 - (8 * len(table)).bit_length())
    return (table.take((bit >> np.uint64(3)).view(np.int64)) >> (bit & np.uint64(7)).astype(np.uint8) & 1).view(bool)


def _near(texts: Texts, starts: np.ndarray, run: int, pad: int, length: int, table: np.ndarray) -> np.ndarray:
    """Which windows have a seed of the table in themselves and the ``pad`` words on both sides."""
    held = np.append(0, np.cumsum(_marked(table, seeds(texts, length))))
    return held[np.minimum(starts + run + pad - length + 1, len(held) - 1)] > held[np.maximum(starts - pad, 0)]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each row of ``a`` (windows) to a part of the same row of ``b``, ``most + 1`` if it is more.

    ``b`` has ``most`` words more on both sides; only places at most ``most`` from the diagonal are computed.
    """
    count, run = a.shape
    above = np.zeros((2 * most + 1, count), dtype=np.int8)
    for i in range(run):
        row = above + (a[:, i] != b.T[i : i + 2 * most + 1])
        row[:-1] = np.minimum(row[:-1], above[1:] + 1)
        for d in range(1, 2 * most + 1):
            row[d] = np.minimum(row[d], row[d - 1] + 1)
        above = np.minimum(row, most + 1).astype(np.int8)
    return above.min(axis=0)


def _around(words: list[bytes], lead: np.ndarray, pad: int, run: int, fill: int) -> np.ndarray:
    """Windows with ``pad`` words on both sides as rows; ``fill`` stands where a text has no words."""
    out = np.full((len(words), run + 2 * pad), fill, dtype=np.uint64)
    begin = (pad - lead)[:, None]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))[:, None] // 8
    column = np.arange(out.shape[1])
    out[(column >= begin) & (column < begin + size)] = np.frombuffer(b"".join(words), dtype=np.uint64)
    return out


def passage_distance(a: np.ndarray, b: np.ndarray, run: int, shift: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance of the passages at most ``shift`` words around two windows that met, whether the windows are equal)."""
    pad = shift + edits
    equal = (a[:, pad : pad + run] == b[:, pad : pad + run]).all(axis=1)
    least = np.zeros(len(a), dtype=np.int8)
    a, b = a[~equal], b[~equal]
    region = a[:, edits : a.shape[1] - edits]  # the words of the windows that may be meant
    # All but ``edits`` words of a passage stand in the document within the band.
    found = np.zeros(region.shape, dtype=bool)
    for d in range(2 * edits + 1):
        found |= region == b[:, d : d + region.shape[1]]
    held = np.cumsum(np.pad(found, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
    best = np.full(len(a), edits + 1, dtype=np.int8)
    for t in sorted(range(-shift, shift + 1), key=abs):
        whole = (a[:, pad + t] != 0) & (a[:, pad + t + run - 1] != 0)  # the window lies within the item
        rows = np.flatnonzero(whole & (held[:, shift + t + run] - held[:, shift + t] >= run - edits) & (best > 0))
        if len(rows):
            best[rows] = np.minimum(best[rows], edit_distance(a[rows, pad + t : pad + t + run], b[rows, pad + t - edits : pad + t + run + edits], edits))
    least[~equal] = best
    return least, equal


def _parts(texts: list[str]) -> Iterator[slice]:
    """Slices of texts of about ``_BATCH_CHARS`` characters."""
    part = np.cumsum([len(t) for t in texts]) // _BATCH_CHARS
    for p in np.unique(part):
        yield slice(*np.searchsorted(part, [p, p + 1]).tolist())


def _described(batches: Iterator[pa.RecordBatch], run: int, edits: int, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``id, place, keys, lead, words`` of the windows of ``id, text``; with a bit table, those with a key in it and only these keys.

    words: the window and at most ``SHIFT + edits`` words on both sides; lead: the number of words before it.
    """
    pad = SHIFT + edits
    for batch in batches:
        all_ids, all_texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        for part in _parts(all_texts):
            texts, ids = Texts(all_texts[part]), all_ids[part]
            all_starts, all_owners = texts.windows(run)
            if table is not None:
                near = _near(texts, all_starts, run, pad, seed_length(run, edits), table)
                all_starts, all_owners = all_starts[near], all_owners[near]
            for begin in range(0, len(all_starts), _BATCH_WORDS):
                starts, owners = all_starts[begin : begin + _BATCH_WORDS], all_owners[begin : begin + _BATCH_WORDS]
                keys = lsh_keys(texts, starts, run)
                hit = np.ones(keys.shape, dtype=bool) if table is None else _marked(table, keys)
                kept = np.flatnonzero(hit.any(axis=1))
                if not len(kept):
                    continue
                begins = np.maximum(starts[kept] - pad, texts.begins[owners[kept]])
                ends = np.minimum(starts[kept] + run + pad, texts.begins[owners[kept] + 1])
                held, hits = keys[kept].view(np.int64), hit[kept]
                columns = [
                    pa.array(ids[owners[kept]], pa.int64()),
                    pa.array(starts[kept] - texts.begins[owners[kept]], pa.int64()),
                    pa.ListArray.from_arrays(np.cumsum([0, *hits.sum(axis=1)], dtype=np.int32), held[hits]),
                    pa.array((starts[kept] - begins).astype(np.int32)),
                    pa.array([texts.hashes[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "place", "keys", "lead", "words"])


def _seeded(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``key``: the seeds of ``text``."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in _parts(texts):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(seeds(Texts(texts[part]), length)).view(np.int64))], names=["key"])


_WINDOWS = "id bigint, place bigint, keys array<bigint>, lead int, words binary"


def _key_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A table of the leading ``bits`` bits of all keys, built by Spark; its size does not depend on the number of keys."""
    bit = keys.select((F.shiftrightunsigned("key", 64 - bits) + 1).alias("bit"))  # Spark's bitmaps count from 1
    rows = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for r in rows.collect():  # at most 2 ** bits / _BUCKET rows of 4 KB
        begin = (r.bucket - 1) * (_BUCKET >> 3)
        table[begin : begin + len(r.bits)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)[: len(table) - begin]
    return table


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, edits: int = EDITS, table_bits: int = TABLE_BITS) -> DataFrame:
    """``doc_id, item_id, distance, shared_runs``: documents (``doc_id, text``) that hold a passage of an item (``item_id, text``).

    distance: the least number of edited words in a passage of ``run`` words, 0 to ``edits``; shared_runs: the number of places in
    the document where ``run`` words of the item stand unedited.
    """
    pad = SHIFT + edits
    known = items.filter("item_id is not null and text is not null").select(F.col("item_id").alias("id"), "text").distinct()
    windows = cut(known.mapInArrow(lambda batches: _described(batches, run, edits, None), _WINDOWS), "items")
    pieces = known.select("text").mapInArrow(lambda batches: _seeded(batches, seed_length(run, edits)), "key bigint")
    keys = windows.select(F.explode("keys").alias("key")).union(pieces)
    table = documents.sparkSession.sparkContext.broadcast(_key_table(keys, table_bits))
    texts = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    hits = cut(texts.mapInArrow(lambda batches: _described(batches, run, edits, table.value), _WINDOWS), "hits")
    ours = hits.select(F.col("id").alias("doc_id"), "place", F.explode("keys").alias("key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    theirs = windows.select(F.col("id").alias("item_id"), F.col("place").alias("at"), F.explode(F.array_distinct("keys")).alias("key")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = ours.join(theirs, ["key", "salt"]).select("doc_id", "place", "item_id", "at").distinct()
    context = lambda side: F.struct("lead", "words").alias(side)
    pairs = met.join(hits.select(F.col("id").alias("doc_id"), "place", context("b")), ["doc_id", "place"])
    pairs = pairs.join(windows.select(F.col("id").alias("item_id"), F.col("place").alias("at"), context("a")), ["item_id", "at"])

    @F.pandas_udf("distance int, equal boolean")
    def judged(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = (_around(x.words.tolist(), x.lead.to_numpy(), pad, run, fill) for fill, x in enumerate((a, b)))
        distance, equal = passage_distance(left, right, run, SHIFT, edits)
        return pd.DataFrame({"distance": distance.astype("int32"), "equal": equal})

    near = pairs.select("doc_id", "item_id", "place", judged("a", "b").alias("j")).select("doc_id", "item_id", "place", "j.*").filter(F.col("distance") <= edits)
    # One row per place first, so that a document or item of any number of places is combined map-side.
    places = near.groupBy("doc_id", "item_id", "place").agg(F.min("distance").alias("distance"), F.max("equal").alias("equal"))
    return places.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.count_if("equal").alias("shared_runs"))


def leaked_items(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold a passage of it, 0 for the clean ones."""
    per_item = leaks.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("shared_runs").alias("most_runs"))
    known = items.filter("item_id is not null").select("item_id", "suite").dropDuplicates(["item_id"])
    return known.join(per_item, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_runs", F.lit(0)).alias("most_runs"))
