"""Benchmark decontamination under edit distance.

A document is contaminated by an item if some stretch of it is within the allowed
word edit distance. Every window of an item's size is a candidate place. Windows and
items are embedded by random walks (CGK): a walk repeats or passes each word by a
random bit of word and step, which turns edits into Hamming distance. Hashes of
positions sampled from the embeddings find windows near an item, with as many
repetitions in each size class as reach the target recall on edited copies of its own
items. A class in which the most repetitions do not reach it is searched without loss, by
the word pairs that a match must share. What either finds is verified by the exact edit distance.

An edit changes two of a window's word pairs at most. Windows with so few pairs known
from items of their size that no edits allowed could explain it cannot match; they are passed over
before the embedding, which loses nothing. Items too short for any edit are looked up as runs of
words. Items are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import text_of
from eventflow.llm.pieces import chunks

WORD = re.compile(r"\w+")
#: Items whose tables one pass over the documents carries, and the characters of their texts.
ITEM_BLOCK = 20_000
BLOCK_CHARS = 4 << 20
WALKS = 8
#: Positions in one hash, and hashes of each walk at most.
SAMPLED = 4
MOST_HASHES = 64
#: Embedding steps per word. A walk takes two on average; later steps are mostly blank and tell nothing apart.
STEPS = 2
#: Items of one size class differ in length by this factor at most.
CLASS_RATIO = 1.1
#: Edited copies on which the recall of a size class is measured, and the windows counted on each side of a copy's start.
TRIALS = 400
NEAR = 16
#: Embedded positions of one step of that measurement.
MEASURED = 1 << 24
WINDOWS = 1 << 16
BLANK = -1
#: Slots of a class's table of known word pairs; two pairs in one slot only let more windows through.
PAIR_SLOTS = 1 << 20


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-cased words, part by part; everything between words is ignored."""
    for part in chunks(text):
        yield WORD.findall(part.lower())


def codes_of(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """The words as numbers, 0 for words of no item."""
    parts = [np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words)) for words in words_of(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def allowed(length: int, similarity: float) -> int:
    """Edits allowed for an item of ``length`` words."""
    return int((1 - similarity) * length + 1e-9)


def walk_bits(symbols: int, steps: int, walk: int) -> np.ndarray:
    """A random 64-bit number for each 64 steps and symbol."""
    return np.random.default_rng(1000 + walk).integers(0, 1 << 64, (-(-steps // 64), symbols), np.uint64, endpoint=False)


def embed(codes: np.ndarray, starts: np.ndarray, width: int, bits: np.ndarray) -> np.ndarray:
    """The CGK embeddings of the windows of ``width`` codes from ``starts`` on; a finished walk gives blanks."""
    out = np.empty((STEPS * width, len(starts)), np.int32)
    at = np.zeros(len(starts), np.int64)
    for step in range(STEPS * width):
        symbol = codes[starts + np.minimum(at, width - 1)]
        out[step] = np.where(at < width, symbol, BLANK)
        at += ((bits[step >> 6][symbol] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
    return out


def sampled_keys(embedded: np.ndarray, walk: int, hashes: int) -> Iterator[np.ndarray]:
    """One key per window and hash, from positions drawn for that walk."""
    random = np.random.default_rng(2000 + walk)
    for _ in range(hashes):
        places = random.integers(0, len(embedded), SAMPLED)
        factors = random.integers(0, 1 << 63, SAMPLED, np.uint64) | np.uint64(1)
        key = np.zeros(embedded.shape[1], np.uint64)
        for place, factor in zip(places, factors):
            key = (key ^ (embedded[place].astype(np.int64).view(np.uint64) + np.uint64(1))) * factor
            key ^= key >> np.uint64(29)
        yield key


def fit(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the stretch of ``region`` nearest to ``item``."""
    # Distances in the high bits, the stretch's start in the low ones, so both are minimised together.
    one, index = 1 << 32, np.arange(len(region) + 1, dtype=np.int64)
    row, steps = index.copy(), index * one
    for symbol in item.tolist():
        changed = row[:-1] + np.where(region == symbol, 0, one)
        best = row + one
        np.minimum(best[1:], changed, out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    end = int(np.argmin(row >> 32))
    return int(row[end] >> 32), int(row[end] & (one - 1)), end


def edited(item: np.ndarray, edits: int, symbols: int, random: np.random.Generator) -> np.ndarray:
    """A copy of ``item`` with random substitutions, insertions and deletions."""
    copy = item.tolist()
    for _ in range(edits):
        kind, new = random.integers(3), int(random.integers(symbols))
        at = int(random.integers(len(copy))) if copy else 0
        if kind == 0 and copy:
            copy[at] = new
        elif kind == 1 or not copy:
            copy.insert(at, new)
        else:
            del copy[at]
    return np.array(copy, np.int64)


def hashes_for(items: list[np.ndarray], width: int, symbols: int, similarity: float, target: float) -> int:
    """Hashes per walk at which edited copies of a class's items at the allowed distance are found with the target recall.

    Zero if the most hashes do not reach it. As in a search, heads of ``width`` words are
    compared and every window about a copy's start counts (beyond NEAR words from it none does, which only adds hashes).
    """
    random = np.random.default_rng(3)
    parts, heads, windows, end = [], [], [], 0
    for i in random.integers(len(items), size=TRIALS).tolist():
        edits = allowed(len(items[i]), similarity)
        near = min(edits, NEAR)
        # The item, then its copy between foreign words.
        parts += [items[i], np.zeros(near, np.int64), edited(items[i], edits, symbols, random), np.zeros(width + near, np.int64)]
        start = end + len(items[i]) + near
        heads.append(end)
        windows.append(np.arange(start - near, start + near + 1))
        end += sum(map(len, parts[-4:]))
    codes, first = np.concatenate(parts), np.full(TRIALS, MOST_HASHES)
    step = max(1, MEASURED // (STEPS * width * (2 * NEAR + 2)))
    for low in range(0, TRIALS, step):
        some = windows[low : low + step]
        owner = np.repeat(np.arange(len(some)), [len(w) for w in some])
        starts = np.concatenate([heads[low : low + step], *some])
        found = first[low : low + step]
        for walk in range(WALKS):
            out = embed(codes, starts, width, walk_bits(symbols, STEPS * width, walk))
            for h, key in enumerate(sampled_keys(out, walk, MOST_HASHES)):
                hit = owner[key[len(some) :] == key[owner]]
                found[hit] = np.minimum(found[hit], h)
    hashes = 1
    while hashes <= MOST_HASHES:
        if (first < hashes).mean() >= target:
            return hashes
        hashes *= 2
    return 0


def item_block(items: list[tuple], similarity: float, target: float) -> dict:
    """The tables of a block of items (id, text): plain arrays, small enough to be sent to every task."""
    texts = [[w for part in words_of(text or "") for w in part] for _, text in items]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
    codes = [np.array([vocabulary[w] for w in t], np.int64) for t in texts]
    limits = [allowed(len(c), similarity) for c in codes]
    classes, members = [], []
    for i in sorted((i for i, limit in enumerate(limits) if limit), key=lambda i: len(codes[i])):
        if members and len(codes[i]) > CLASS_RATIO * len(codes[members[0]]):
            classes.append(members)
            members = []
        members.append(i)
    classes += [members] if members else []
    tables = []
    for members in classes:
        width, edits = len(codes[members[0]]), allowed(len(codes[members[-1]]), similarity)
        hashes = hashes_for([codes[i] for i in members], width, len(vocabulary) + 1, similarity, target)
        if not hashes:
            tables.append({"hashes": 0, "edits": edits, **postings(codes, members, similarity)})
            continue
        heads = np.concatenate([codes[i][:width] for i in members])
        starts = np.arange(len(members)) * width
        keys, pairs = [], np.zeros(PAIR_SLOTS + 1, bool)
        for i in members:
            pairs[pair_slots(codes[i])] = True
        for walk in range(WALKS):
            out = embed(heads, starts, width, walk_bits(len(vocabulary) + 1, STEPS * width, walk))
            for key in sampled_keys(out, walk, hashes):
                order = np.argsort(key, kind="stable")
                keys.append((key[order], np.array(members)[order]))
        tables.append({"hashes": hashes, "width": width, "edits": edits, "keys": keys, "pairs": pairs})
    return {
        "ids": [i for i, _ in items], "codes": codes, "vocabulary": vocabulary, "classes": tables,
        "runs": runs({i: codes[i].tolist() for i, limit in enumerate(limits) if not limit and len(codes[i])}),
        "distinct": [frozenset(c.tolist()) for c in codes], "limits": limits,
    }


def runs(items: dict[int, list[int]]) -> list[tuple[np.ndarray, dict[int, list[int]]]]:
    """The trie of items that allow no edit, level by level: the sorted (parent node, word) of its nodes, and the items that end at a node."""
    levels, node, depth = [], dict.fromkeys(items, 0), 0
    while node:
        step = {i: (parent << 32) + items[i][depth] for i, parent in node.items()}
        keys = np.unique(np.fromiter(step.values(), np.int64, len(step)))
        node = {i: int(np.searchsorted(keys, key)) for i, key in step.items()}
        depth += 1
        ended: dict[int, list[int]] = {}
        for i in [i for i in node if len(items[i]) == depth]:
            ended.setdefault(node.pop(i), []).append(i)
        levels.append((keys, ended))
    return levels


def run_matches(codes: np.ndarray, ends: np.ndarray, levels: list[tuple[np.ndarray, dict[int, list[int]]]]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, start, end) of the first place in each text of each item in the trie; a foreign word follows each text."""
    at = np.flatnonzero(codes) if levels else np.empty(0, np.int64)
    node = np.zeros(len(at), np.int64)
    for depth, (keys, ended) in enumerate(levels):
        wanted = (node << 32) + codes[at + depth]
        node = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[node] == wanted
        at, node = at[known], node[known]
        if not len(at):
            return
        if ended:
            text = np.searchsorted(ends, at, side="right")
            last = np.isin(node, np.fromiter(ended, np.int64, len(ended)))
            _, first = np.unique(text[last] * len(keys) + node[last], return_index=True)
            for t, n, start in zip(text[last][first].tolist(), node[last][first].tolist(), at[last][first].tolist()):
                for item in ended[n]:
                    yield t, item, start, start + depth + 1


def pair_slots(codes: np.ndarray) -> np.ndarray:
    """The slot of each pair of neighbouring words; the last, always empty one if a word is in no item."""
    mixed = (codes[:-1] * 0x9E3779B1 + codes[1:]) * 0x85EBCA6B
    return np.where((codes[:-1] > 0) & (codes[1:] > 0), (mixed >> 16) & (PAIR_SLOTS - 1), PAIR_SLOTS)


def grams_of(codes: np.ndarray, size: int) -> np.ndarray:
    """One number per word or pair of neighbouring words, -1 if a word is in no item."""
    grams = codes if size == 1 else (codes[:-1] << 32) + codes[1:]
    return np.where(grams > 0 if size == 1 else (codes[:-1] > 0) & (codes[1:] > 0), grams, -1)


def postings(codes: list[np.ndarray], members: list[int], similarity: float) -> dict:
    """Where each word pair (each word, if few pairs need be shared) stands in the items of a class."""
    edits = np.array([allowed(len(codes[i]), similarity) for i in members])
    lengths = np.array([len(codes[i]) for i in members])
    size = 2 if (lengths - 1 - 2 * edits).min() > 0 else 1
    grams = [grams_of(codes[i], size) for i in members]
    order = np.argsort(whole := np.concatenate(grams), kind="stable")
    item = np.repeat(np.arange(len(members)), [len(g) for g in grams])
    return {
        "size": size, "grams": whole[order], "item": item[order], "offset": np.concatenate([np.arange(len(g)) for g in grams])[order],
        "members": np.array(members), "limits": edits, "least": np.maximum(1, lengths - size + 1 - size * edits), "reach": int((lengths + 2 * edits).max()),
    }


def all_candidates(codes: np.ndarray, table: dict) -> np.ndarray:
    """(item, start) with a start at most the allowed edits away from each match's, each once.

    An edit takes away one word or two pairs at most, and moves the others by one place at
    most: a match shares the rest with the item, at starts within the edits on both sides of its own.
    """
    grams, found = grams_of(codes, table["size"]), []
    # Ranges overlap by more than a match, so each match is whole in one.
    for low in range(0, max(len(grams), 1), WINDOWS):
        part = grams[low : low + WINDOWS + table["reach"]]
        first = np.searchsorted(table["grams"], part)
        count = np.searchsorted(table["grams"], part, "right") - first
        which = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, start = table["item"][which], np.repeat(np.arange(len(part)), count) - table["offset"][which]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        place = (item << 32) + start + table["reach"]
        shared = np.searchsorted(place, place + 2 * table["limits"][item], "right") - np.arange(len(place))
        enough = shared >= table["least"][item]
        found.append(np.column_stack([table["members"][item[enough]], start[enough] + low]))
    return np.unique(np.concatenate(found), axis=0)


def candidates(codes: np.ndarray, slots: np.ndarray, table: dict, symbols: int) -> np.ndarray:
    """(item, start) of windows that share a hash with an item of the class, each once."""
    if not table["hashes"]:
        return all_candidates(codes, table)
    width, hashes, found = table["width"], table["hashes"], []
    if len(codes) < width:
        return np.empty((0, 2), np.int64)
    # before[i] counts the known pairs that begin before word i; a window of w words has w - 1 pairs.
    before = np.zeros(len(codes), np.int32)
    np.cumsum(table["pairs"][slots], out=before[1:])
    inside = before[width - 1 :] - before[: len(before) - width + 1]
    starts = np.flatnonzero(inside >= width - 1 - 2 * table["edits"])
    for first in range(0, len(starts), WINDOWS):
        part = starts[first : first + WINDOWS]
        for walk in range(WALKS):
            out = embed(codes, part, width, walk_bits(symbols, STEPS * width, walk))
            for h, key in enumerate(sampled_keys(out, walk, hashes)):
                known, items = table["keys"][walk * hashes + h]
                low = np.searchsorted(known, key)
                hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == key)
                if len(hit):
                    count = np.searchsorted(known, key[hit], "right") - low[hit]
                    which = np.repeat(low[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    found.append(np.column_stack([items[which], np.repeat(part[hit], count)]))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def matches(texts: list[str], block: dict) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, end word) of each text and item that match, at the best stretch."""
    vocabulary, limits = block["vocabulary"], block["limits"]
    # Between texts, and after the last, stand foreign words, as many as a window may reach beyond its text.
    gap = np.zeros(max((t["edits"] for t in block["classes"]), default=0) + 1, np.int64)
    coded, result = [], []
    for text in texts:
        coded += [codes_of(text, vocabulary), gap]
    if not coded:
        return result
    codes = np.concatenate(coded)
    ends = np.cumsum([len(c) for c in coded])[::2]
    begins = ends - np.array([len(c) for c in coded[::2]])
    for t, item, start, end in run_matches(codes, ends, block["runs"]):
        result.append((t, item, 0, start - int(begins[t]), end - int(begins[t])))
    slots = pair_slots(codes)
    for table in block["classes"]:
        found = candidates(codes, slots, table, len(vocabulary) + 1)
        if not len(found):
            continue
        text = np.searchsorted(ends, found[:, 1], side="left")
        text = np.minimum(text, len(ends) - 1)
        last, region = None, None
        regions = []
        for item, start, t in zip(found[:, 0].tolist(), found[:, 1].tolist(), text.tolist()):
            # Neighbouring windows of one item and text are verified in one region.
            # A start may lie the allowed edits before the match's, and the match be longer than the item by as many.
            end = start + len(block["codes"][item]) + 2 * limits[item]
            if (item, t) == last and start <= region[1]:
                region[1] = max(region[1], end)
            else:
                region = [start - limits[item], end]
                regions.append((item, t, region))
                last = (item, t)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, t, (low, high) in regions:
            low, high = max(low, int(begins[t])), min(high, int(ends[t]))
            distinct = block["distinct"][item]
            # An edit takes away one word at most: with fewer words in common there is nothing to verify.
            if len(distinct.intersection(codes[low:high].tolist())) < len(distinct) - limits[item]:
                continue
            distance, first, end = fit(block["codes"][item], codes[low:high])
            if distance <= limits[item]:
                at = (distance, low - int(begins[t]) + first, low - int(begins[t]) + end)
                best[t, item] = min(best.get((t, item), at), at)
        result += [(t, item, *at) for (t, item), at in best.items()]
    return sorted(result)


def blocks(benchmark: DataFrame, similarity: float, target: float, id_col: str | None, text_col: str) -> Iterator[dict]:
    """The tables of the items in blocks, bounded in items and in characters (a longer item makes a block alone)."""
    held: list[tuple] = []
    size = 0
    ids = F.lit(None) if id_col is None else F.col(id_col)
    for row in benchmark.select(ids.cast("long"), text_of(text_col)).toLocalIterator():
        if held and (len(held) >= ITEM_BLOCK or size + len(row[1]) > BLOCK_CHARS):
            yield item_block(held, similarity, target)
            held, size = [], 0
        held.append(tuple(row))
        size += len(row[1])
    if held:
        yield item_block(held, similarity, target)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target: float = 0.98,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each document row and benchmark item that match: doc_id, item_id, distance, item_words, first_word, end_word.

    They match if some stretch of the document's words (lower case, without punctuation) is
    at most (1 - similarity) * item_words word edits away from the item; the stretch with
    the least distance is given, the first of equal ones for items that allow no edit (at 0.8
    those of under five words). Items without words match nothing. Null texts count as
    empty; null ids and repeated rows are passed on. An empty table on either side gives
    an empty result.
    """
    schema = "doc_id long, item_id long, distance int, item_words int, first_word long, end_word long"
    found = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col))
    for block in blocks(benchmark, similarity, target, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                keys = batch.column(0).to_pylist()
                hits = [
                    (keys[t], items["ids"][i], d, len(items["codes"][i]), first, end)
                    for t, i, d, first, end in matches(batch.column(1).to_pylist(), items)
                ]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*hits) if hits else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "distance", "item_words", "first_word", "end_word"],
                )

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def leaking(text: Column, sent) -> Column:
    """Whether a text matches an item of a broadcast block."""

    @F.pandas_udf("boolean")
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = np.zeros(len(batch), bool)
            out[[m[0] for m in matches(batch.tolist(), sent.value)]] = True
            yield pd.Series(out)

    return leaks(text)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target: float = 0.98, text_col: str = "text", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns; matches are those of ``find_leaks``.

    Rows with a null or empty text stay, repeated rows share one fate, ids are not read. An
    empty benchmark leaves ``docs`` as it is. Further columns, of any name, are passed on.
    """
    for block in blocks(benchmark, similarity, target, None, item_text_col):
        docs = docs.where(~leaking(text_of(text_col), docs.sparkSession.sparkContext.broadcast(block)))
    return docs
