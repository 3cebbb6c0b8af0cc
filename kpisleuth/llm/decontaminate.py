"""Benchmark items in documents, up to a share of edits.

Texts are made canonical: lower case, runs of other than letters and digits are
one space.  A CGK random walk embeds a stretch of text: at each step the current
byte is written and the walk moves on if a random function of step and byte says
so.  After an edit two walks fall into step again soon, so few edits become a
small Hamming distance.  Each of ``WALKS`` walks is sampled at ``SAMPLES`` sets of
``BITS_EACH`` steps; the sampled symbols hash to keys.  Walks start in documents at
every ``STRIDE``-th word, and in each item at every word, so that a document
window anywhere in a passage meets the probe of the same place in the item.

Exact copies don't depend on words: of every ``SPAN`` successive places, in bytes,
the one whose next ``SEED`` bytes have the smallest hash is a seed on both sides, so
any ``SHORTEST`` bytes in common hold one.  Items shorter than that meet documents by
their first ``HEAD`` bytes, which are looked up at every byte.

Keys of documents pass a Bloom filter of all probe keys (its size is fixed by
the number of probes and bounded by ``FILTER_BITS``; a larger benchmark only lets
more keys through), then a hash join with the probes.  A match names an item and
its place in the document; the exact edit distance of the whole item to the best
stretch there decides.  With the numbers below, at edits of 5 percent of an item
spread at random, tests find at least 95 of 100 copies.

Defined cases: a null or empty text, or one without letters and digits, contains
nothing; items of fewer than ``SHORTEST`` canonical bytes are met by an unedited head
only, and those of fewer than ``HEAD`` aren't searched, they say nothing; null ids stay null in the result; rows with equal ids and texts give one
result; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import forget, written
from kpisleuth.llm.wordhash import byte_values, chunks, columns, mix, powers, salts

WALKS = 2
REACHES = (56, 72, 88, 104)  # steps of the walk that a set of samples is drawn from
BITS_EACH = 16
STRIDE = 4
SHORTEST = 48
SEED, SPAN = 32, 17  # SEED + SPAN - 1 = SHORTEST
HEAD = 16
EDITS = 0.05
FILTER_BITS = 27


def canonical(texts: pa.Array) -> pa.Array:
    """Canonical texts, each closed by a zero byte at which a walk stays."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    plain = pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\p{L}\p{N}]+", " "), " ")
    return pc.binary_join_element_wise(plain, pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string()))


def _walk_tables() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """moves[walk, step, byte] in {0, 1}, and the sampled steps of each set."""
    rng = np.random.default_rng(77)
    moves = rng.integers(0, 2, (WALKS, max(REACHES), 256), dtype=np.uint8)
    moves[:, :, 0] = 0
    steps = [[np.sort(rng.choice(reach, BITS_EACH, replace=False)) for reach in REACHES] for _ in range(WALKS)]
    return moves, steps


def keys_at(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the walks from each start (start x key), and whether a walk had text for all of its samples."""
    moves, steps = _walk_tables()
    keys = np.zeros((len(starts), WALKS * len(REACHES)), np.uint64)
    whole = np.ones(keys.shape, bool)
    salt, apart = salts(BITS_EACH, 61), salts(keys.shape[1], 67)
    for w in range(WALKS):
        sums = [np.zeros(len(starts), np.uint64) for _ in REACHES]
        seen = [0] * len(REACHES)
        at = starts.astype(np.int64).copy()
        for step in range(max(REACHES)):
            symbol = data[at]
            for k, chosen in enumerate(steps[w]):
                if seen[k] < BITS_EACH and chosen[seen[k]] == step:
                    sums[k] += symbol * salt[seen[k]]
                    seen[k] += 1
                    if seen[k] == BITS_EACH:
                        whole[:, w * len(REACHES) + k] = symbol != 0
            at += moves[w, step][symbol]
        for k, total in enumerate(sums):
            column = w * len(REACHES) + k
            keys[:, column] = mix(total + apart[column])
    return keys, whole


def word_starts(part: np.ndarray) -> np.ndarray:
    inside = (part != 32) & (part != 0)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    return np.flatnonzero(start)


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over each ``width`` successive values."""
    out, reach = values, 1
    while reach < width:
        by = min(reach, width - reach)
        out, reach = best(out[:-by], out[by:]), reach + by
    return out


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(False)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size))


def seeds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is the smallest of some ``SPAN`` successive ones, and the hashes."""
    grams = _grams(data, SEED)
    if len(grams) < SPAN:
        return np.zeros(0, np.int64), grams[:0]
    edge = np.zeros(SPAN - 1, np.uint64)
    lowest = np.concatenate([edge, _slide(grams, SPAN, np.minimum), edge])
    places = np.flatnonzero(_slide(lowest, SPAN, np.maximum) == grams)
    return places, grams[places]


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = canonical(batch.column(1))
        data, offsets = columns(text)
        out = {"item_id": [], "offset": [], "key": []}
        for i, item in enumerate(batch.column(0).to_pylist()):
            part = data[offsets[i]: offsets[i + 1]]
            if len(part) - 1 < HEAD:
                continue
            if len(part) - 1 < SHORTEST:
                places, found = np.zeros(1, np.int64), _grams(part[:HEAD], HEAD)
            else:
                starts = word_starts(part)
                keys, whole = keys_at(part, starts)
                row, column = np.nonzero(whole)
                places, found = seeds(part[:-1])
                places, found = np.append(starts[row], places), np.append(keys[row, column], found)
            out["item_id"] += [item] * len(places)
            out["offset"] += places.tolist()
            out["key"] += found.view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["item_id"], pa.int64()), pa.array(out["offset"], pa.int64()), pa.array(out["key"], pa.int64())],
            names=["item_id", "offset", "key"])


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a key in a filter of ``size`` bits."""
    mask = np.uint64(size - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def _filter(probes: DataFrame) -> np.ndarray:
    """Bloom filter of the probe keys, merged by Spark from bitmaps of 4 KB; at most 16 MB."""
    n = probes.count()
    bits = min(max(256 * n, 1 << 20).bit_length(), FILTER_BITS)
    size = 1 << bits
    places = probes.select("key").distinct().select(F.explode(F.array(
        F.col("key").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(size - 1)))).alias("place"))
    bucket = F.floor(F.col("place") / 32768)
    maps = places.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("map")).collect()
    out = np.zeros(size // 8, np.uint8)
    for row in maps:
        out[row["bucket"] * 4096: row["bucket"] * 4096 + len(row["map"])] = np.frombuffer(bytes(row["map"]), np.uint8)
    return out


def _has(filled: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (filled[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


REGIONS = "doc_id long, region binary, start long, places array<long>, keys array<long>"


def _windows(filled: np.ndarray, around: int, short: bool):
    """Regions of documents with a key in the filter: ``around`` bytes to both sides of each such window.

    ``short``: there are items to be met by their heads.
    """
    size = len(filled) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("tokens:")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = columns(canonical(batch.column(1)))
            out: list[tuple] = []
            for first, last in chunks(offsets):
                part = data[offsets[first]: offsets[last]]
                rows = offsets[first: last + 1] - offsets[first]
                starts = word_starts(part)
                first_word = np.searchsorted(starts, rows)
                owner = np.searchsorted(rows, starts, side="right") - 1
                chosen = (np.arange(len(starts)) - first_word[owner]) % STRIDE == 0
                starts = starts[chosen]
                keys, _ = keys_at(part, starts)
                met = [(np.repeat(starts, keys.shape[1]), keys.reshape(-1)), seeds(part)]
                if short:
                    heads = _grams(part, HEAD)
                    met.append((np.arange(len(heads)), heads))
                kept = []
                for places, found in met:
                    one, two = _bits(found, size)
                    hit = _has(filled, one)
                    hit[hit] = _has(filled, two[hit])
                    kept.append((places[hit], found[hit]))
                at, key = (np.concatenate(x) for x in zip(*kept, strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                doc = np.searchsorted(rows, at, side="right") - 1
                place, row = at - rows[doc], at
                cut = np.flatnonzero((doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 2 * around)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(row)], strict=True):
                    d = int(doc[a])
                    begin = max(0, int(place[a]) - around)
                    end = min(int(rows[d + 1] - rows[d]) - 1, int(place[b - 1]) + around)
                    region = part[int(rows[d]) + begin: int(rows[d]) + end].tobytes()
                    out.append((ids[first + d], region, begin, place[a:b].tolist(), key[a:b].view(np.int64).tolist()))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cells = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)],
                                             names=["doc_id", "region", "start", "places", "keys"])

    return run


def best_stretch(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(edits, end) of the stretch of ``text`` nearest to ``item``, if within ``most`` edits.

    Myers' bit-parallel recurrence for approximate search; the first best end wins.
    """
    exact = text.find(item)
    if exact >= 0:
        return 0, exact + len(item)
    m = len(item)
    peq: dict[int, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0) if m <= most else (most + 1, -1)  # the empty stretch, or none yet
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


GRAM = 4


def gram_codes(text: np.ndarray) -> np.ndarray:
    """16-bit codes of the runs of GRAM bytes."""
    n = max(len(text) - GRAM + 1, 0)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = code * np.uint32(0x01000193) + text[k: k + n]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _verify(share: float):
    """Edit distance at each place; stretches that hold too few of the item's runs of bytes for it are skipped.

    A copy of m bytes with k edits keeps at least m - GRAM + 1 - k * GRAM of the item's runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[bytes, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            columns_ = [c.to_pylist() for c in batch.columns]
            for doc, region, start, item, text, places in zip(*columns_, strict=True):
                item_text = text[:-1]
                most = int(share * len(item_text))
                if text not in tables:
                    if len(tables) > 2000:
                        tables.clear()
                    tables[text] = np.zeros(1 << 16, bool)
                    tables[text][gram_codes(np.frombuffer(item_text, np.uint8))] = True
                common = np.zeros(len(region) + 1, np.int64)
                shown = tables[text][gram_codes(np.frombuffer(region, np.uint8))]
                np.cumsum(shown, out=common[1: len(shown) + 1])
                common[len(shown) + 1:] = common[len(shown)]
                needed = len(item_text) - GRAM + 1 - GRAM * most
                slack, best = 2 * most + 64, None
                # Places where the item would begin; near ones share a stretch.
                stretches: list[list[int]] = []
                for place in sorted(set(places)):
                    low, high = max(0, place - start - slack), place - start + len(item_text) + slack
                    if stretches and low <= stretches[-1][1]:
                        stretches[-1][1] = max(stretches[-1][1], high)
                    else:
                        stretches.append([low, high])
                for low, high in stretches:
                    if common[min(high, len(region))] - common[min(low, len(region))] < needed:
                        continue
                    found = best_stretch(item_text, region[low:high], most)
                    if found and (best is None or found[0] < best[0]):
                        best = (found[0], start + low + found[1])
                if best:
                    out.append((doc, item, best[0], best[1], len(item_text)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            cells = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)],
                                             names=["doc_id", "item_id", "edits", "stop", "item_length"])

    return run


def _canonical_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), canonical(batch.column(1)).cast(pa.large_binary()).cast(pa.binary())],
                                         names=["item_id", "item"])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """(doc_id, item_id, edits, stop, item_length) of each item that a document contains; ``stop`` is a canonical byte offset."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    texts = written(items.mapInArrow(_canonical_items, "item_id long, item binary").where(F.length("item") > HEAD).distinct(), "leak-items")
    probes = written(items.mapInArrow(_probes, "item_id long, offset long, key long").distinct(), "leak-probes")
    shortest, longest = (n or 0 for n in texts.agg(F.min(F.length("item")), F.max(F.length("item"))).first())
    around = int(longest * (1 + 2 * share)) + 128
    regions = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _windows(_filter(probes), around, shortest <= SHORTEST), REGIONS)
    regions = written(regions.withColumn("region_id", F.xxhash64("doc_id", "start", "region")), "leak-regions")
    hits = regions.select("region_id", F.explode(F.arrays_zip("places", "keys")).alias("z")).select("region_id", "z.places", F.col("z.keys").alias("key"))
    begins = hits.join(probes, "key").groupBy("region_id", "item_id").agg(
        F.collect_set(F.col("places") - F.col("offset")).alias("places"))
    pairs = begins.join(regions.select("region_id", "doc_id", "region", "start").dropDuplicates(["region_id"]), "region_id").join(texts, "item_id")
    return pairs.select("doc_id", "region", "start", "item_id", "item", "places").mapInArrow(
        _verify(share), "doc_id long, item_id long, edits long, stop long, item_length long").groupBy("doc_id", "item_id").agg(
        F.min(F.struct("edits", "stop", "item_length")).alias("best")).select("doc_id", "item_id", "best.*")
