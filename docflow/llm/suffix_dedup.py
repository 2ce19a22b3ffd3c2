"""Suffix-array deduplication: bytes of strings that occur in an earlier document.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in
a document with a smaller doc_id. All strings are judged on the input.

1. Strings are grouped into windows by the piece of least hash they hold
   (their anchor). Equal strings have equal anchors at equal places, so they
   meet among the windows of one anchor. Every window becomes two hashes, of
   its anchor and of all its bytes, and these are cut into blocks by anchor.
   Windows of equal bytes are settled here: their strings occur where the
   window of the smallest doc_id lies.
2. Windows that share an anchor with windows of other bytes go on with their
   bytes, one for each. Those of one anchor are trimmed to what they have in
   common with any other of it, and the strings of what is left are ordered by
   a suffix array built from Lyndon groups; neighbours that agree in ``LENGTH``
   bytes are equal strings, and the smallest doc_id among them decides.
3. The removed runs of a document are joined to its text.

Texts cross the network packed. Blocks and bins are cut by the size of the
data. Windows of one anchor are one group of step 2, one for each different
surrounding, and so is a very frequent anchor in very many surroundings.

Defined results: a null text counts as empty; texts shorter than ``LENGTH``
lose nothing; a null doc_id neither loses bytes nor makes others lose any; rows
of one doc_id don't count as earlier than one another. Rows come back as often
as they go in. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm import anchors, words
from docflow.llm.suffix_sort import suffix_array
from docflow.session import materialize

LENGTH = 50
ANCHOR = 20
BLOCK_BYTES = 24 << 20
BIN_BYTES = 2 << 20
LOW = (1 << 48) - 1


def _keys(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One number per (anchor, bytes) for finding a window again in its document."""
    return words.mix((context & np.uint64(LOW)) ^ (anchor.astype(np.uint64) << np.uint64(32))) + anchor.astype(np.uint64)


def window_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, entries): per document its windows in the block, packed."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["doc_id"].to_numpy(np.int64)
            for first, group in anchors.groups(part["text"].tolist()):
                own, _, _, anchor, context = anchors.windows(group, LENGTH, ANCHOR)
                if not len(own):
                    continue
                block = (anchor % np.uint64(blocks)).astype(np.int64)
                by_block = np.argsort(block, kind="stable")
                own, anchor, context, block = own[by_block], anchor[by_block], context[by_block], block[by_block]
                # A document's windows in a block are one run.
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
                run = np.flatnonzero(new)
                sizes = np.diff(np.concatenate([run, [len(own)]])).astype(np.uint32)
                docs_of = ids[first + own[run]]
                high = (anchor >> np.uint64(32)).astype(np.uint32)
                low, rest = context.astype(np.uint32), ((context & np.uint64(LOW)) >> np.uint64(32)).astype(np.uint16)
                used, starts = np.unique(block, return_index=True)
                ends = np.concatenate([starts[1:], [len(own)]])
                run_starts, run_ends = np.searchsorted(run, starts), np.searchsorted(run, ends)
                yield pd.DataFrame(
                    {
                        "block": used,
                        "runs": run_ends - run_starts,
                        "entries": [
                            b"".join((docs_of[a:b].tobytes(), sizes[a:b].tobytes(), high[s:e].tobytes(), low[s:e].tobytes(), rest[s:e].tobytes()))
                            for a, b, s, e in zip(run_starts, run_ends, starts, ends)
                        ],
                    }
                )

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(
        cut, "block long, runs long, entries binary"
    )


def settle(blocks: int):
    """Keys of the windows of a block that are found earlier, or are to be compared, by group of documents."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        doc, key, found = _settled(part)
        group = (words.mix(doc.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        doc, key, found, group = doc[order], key[order], found[order], group[order]
        used, starts = np.unique(group, return_index=True)
        ends = [*starts[1:], len(group)]
        return pd.DataFrame(
            {
                "docs": used,
                "keys": [doc[s:e].tobytes() + key[s:e].tobytes() + found[s:e].tobytes() for s, e in zip(starts, ends)],
            }
        )

    return run


def by_document(part: pd.DataFrame) -> pd.DataFrame:
    """Per document of a group its keys from all blocks."""
    sizes = [len(k) // 17 for k in part["keys"]]
    doc = np.concatenate([np.frombuffer(k, np.int64, n) for k, n in zip(part["keys"], sizes)])
    key = np.concatenate([np.frombuffer(k, np.uint64, n, 8 * n) for k, n in zip(part["keys"], sizes)])
    found = np.concatenate([np.frombuffer(k, np.bool_, n, 16 * n) for k, n in zip(part["keys"], sizes)])
    order = np.lexsort((found, doc))
    doc, key, found = doc[order], key[order], found[order]
    ids, starts = np.unique(doc, return_index=True)
    ends = np.concatenate([starts[1:], [len(doc)]])
    middle = starts + np.add.reduceat((~found).astype(np.int64), starts) if len(ids) else starts
    return pd.DataFrame(
        {
            "doc_id": ids,
            "found": [key[m:e].tobytes() for m, e in zip(middle, ends)],
            "open": [key[s:m].tobytes() for s, m in zip(starts, middle)],
        }
    )


def _settled(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, key, and whether an earlier document has the window, of the windows that matter."""
    pieces: list[list[np.ndarray]] = [[], [], [], []]
    for runs, data in zip(part["runs"].tolist(), part["entries"]):
        n = (len(data) - 12 * runs) // 10
        at = 12 * runs
        docs = np.repeat(np.frombuffer(data, np.int64, runs), np.frombuffer(data, np.uint32, runs, 8 * runs))
        pieces[0].append(docs)
        pieces[1].append(np.frombuffer(data, np.uint32, n, at))
        pieces[2].append(np.frombuffer(data, np.uint32, n, at + 4 * n))
        pieces[3].append(np.frombuffer(data, np.uint16, n, at + 8 * n))
    doc, anchor, low, rest = map(np.concatenate, pieces)
    context = low.astype(np.uint64) | (rest.astype(np.uint64) << np.uint64(32))
    order = np.lexsort((doc, context, anchor))
    doc, anchor, context = doc[order], anchor[order], context[order]
    new_anchor = np.ones(len(doc), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new = new_anchor.copy()
    new[1:] |= context[1:] != context[:-1]
    first = np.flatnonzero(new)
    of_context = np.cumsum(new) - 1
    least = doc[first]
    found = doc > least[of_context]
    of_anchor = np.cumsum(new_anchor) - 1
    contexts = np.bincount(of_anchor[first])
    # Of windows of equal bytes, the smallest doc_id speaks for all.
    open_ = (contexts[of_anchor] > 1) & (doc == least[of_context])
    used = found | open_
    return doc[used], _keys(anchor[used], context[used]), found[used]


def locate(blocks: int):
    """Windows of a text by their keys: removed runs, and windows to be compared, with their bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [zlib.decompress(z).decode() for z in part["packed"]]
            rows = []
            for first, group in anchors.groups(texts):
                own, start, count, anchor, context = anchors.windows(group, LENGTH, ANCHOR)
                bounds = np.searchsorted(own, np.arange(len(group) + 1))
                keys = _keys((anchor >> np.uint64(32)).astype(np.uint32), context)
                for i, data in enumerate(group):
                    row = part.iloc[first + i]
                    here = slice(bounds[i], bounds[i + 1])
                    own_keys = keys[here]
                    full = np.isin(own_keys, np.frombuffer(row["found"], np.uint64))
                    if full.any():
                        s = start[here][full]
                        rows.append((row["doc_id"], row["digest"], np.stack([s, s + count[here][full] + LENGTH - 1], 1).astype(np.int32).tobytes(), None, None, None))
                    if len(row["open"]):
                        for w in np.flatnonzero(np.isin(own_keys, np.frombuffer(row["open"], np.uint64)) & ~full).tolist():
                            w += int(bounds[i])
                            s = int(start[w])
                            rows.append((row["doc_id"], row["digest"], None, int(anchor[w] >> np.uint64(1)), s, data[s : s + int(count[w]) + LENGTH - 1]))
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "digest", "runs", "anchor", "start", "bytes"])
                out["anchor"], out["start"] = out["anchor"].astype("Int64"), out["start"].astype("Int64")
                yield out

    return run


def _trim(texts: list[bytes], place: list[int]) -> list[tuple[int, int]]:
    """Of windows of one anchor, the part each has in common with any other, around the anchor."""

    def common(sides: list[bytes]) -> list[int]:
        order = sorted(range(len(sides)), key=sides.__getitem__)
        out = [0] * len(sides)
        for a, b in zip(order, order[1:]):
            x, y = sides[a], sides[b]
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                n = next(i for i in range(n) if x[i] != y[i])
            out[a], out[b] = max(out[a], n), max(out[b], n)
        return out

    before = common([t[p::-1][1:] if p else b"" for t, p in zip(texts, place)])
    after = common([t[p:] for t, p in zip(texts, place)])
    return [(p - b, p + a) for p, b, a in zip(place, before, after)]


def compare(part: pd.DataFrame) -> pd.DataFrame:
    """Removed runs of the windows of a bin, by a suffix array over their common parts."""
    part = part.sort_values(["anchor", "doc_id", "digest", "start"], kind="stable")
    doc, digest = part["doc_id"].tolist(), part["digest"].tolist()
    start, texts, anchor = part["start"].tolist(), part["bytes"].tolist(), part["anchor"].to_numpy()
    out_row: list[int] = []
    out_runs: list[tuple[int, int]] = []
    strings: list[bytes] = []
    owners: list[int] = []
    users: list[list[tuple[int, int]]] = []
    bounds = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(texts)]
    for begin, end in zip(bounds, bounds[1:]):
        if end - begin < 2:
            continue
        own = texts[begin:end]
        # The first window holds the anchor's bytes; find its place by the least hash.
        places = [_anchor_place(t) for t in own]
        by_string: dict[bytes, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(_trim(own, places)):
            if b - a >= LENGTH:
                by_string.setdefault(own[i][a:b], []).append((begin + i, start[begin + i] + a))
        for string, uses in by_string.items():
            least = min(doc[row] for row, _ in uses)
            later = [(row, at) for row, at in uses if doc[row] > least]
            for row, at in later:
                out_row.append(row)
                out_runs.append((at, at + len(string)))
            if len(by_string) > 1:
                strings.append(string)
                owners.append(least)
                users.append([(row, at) for row, at in uses if doc[row] == least])
    if strings:
        for number, first, last in _earlier(strings, owners):
            for row, at in users[number]:
                out_row.append(row)
                out_runs.append((at + first, at + last + LENGTH))
    runs = np.array(out_runs, np.int32).reshape(-1, 2)
    return pd.DataFrame(
        {
            "doc_id": np.array([doc[r] for r in out_row], np.int64),
            "digest": [digest[r] for r in out_row],
            "runs": [r.tobytes() for r in runs],
        }
    )


def _anchor_place(window: bytes) -> int:
    sums, inverse = words.prefix_hashes(np.frombuffer(window, np.uint8))
    pieces = words.mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(sums) - ANCHOR])
    width = len(window) - LENGTH + 1
    # Every string of the window holds the anchor, so it lies in all of them.
    low, high = width - 1, LENGTH - ANCHOR + 1
    return low + int(pieces[low:high].argmin()) if low < high else 0


def _earlier(strings: list[bytes], owners: list[int]) -> list[tuple[int, int, int]]:
    """(number, first, last start): strings of LENGTH bytes that have a smaller owner elsewhere."""
    lengths = np.array([len(s) + 1 for s in strings])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    joined = b"\0".join(strings) + b"\0"
    order = np.array(suffix_array(joined), np.int64)
    number = np.searchsorted(begins, order, side="right") - 1
    fits = order - begins[number] <= lengths[number] - 1 - LENGTH
    order, number = order[fits], number[fits]
    if not len(order):
        return []
    same = np.array([joined[a : a + LENGTH] == joined[b : b + LENGTH] for a, b in zip(order[:-1].tolist(), order[1:].tolist())], bool)
    head = np.concatenate([[True], ~same])
    group = np.cumsum(head) - 1
    owner = np.array(owners, np.int64)[number]
    least = np.minimum.reduceat(owner, np.flatnonzero(head))
    later = np.sort(order[owner > least[group]])
    if not len(later):
        return []
    number = np.searchsorted(begins, later, side="right") - 1
    cut = np.flatnonzero((later[1:] != later[:-1] + 1) | (number[1:] != number[:-1])) + 1
    firsts, lasts = np.concatenate([[0], cut]), np.concatenate([cut, [len(later)]]) - 1
    return [
        (int(number[f]), int(later[f] - begins[number[f]]), int(later[e] - begins[number[f]]))
        for f, e in zip(firsts, lasts)
    ]


def take_out(data: bytes, runs: list[bytes] | None) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs, and SHA-256 of the rest."""
    if runs is None or not len(runs):
        return 0, 0, hashlib.sha256(data).hexdigest()
    spans = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    count = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return int(gone.sum()), count, hashlib.sha256(kept).hexdigest()


def _pack(text: pd.Series) -> pd.Series:
    return pd.Series([zlib.compress((t or "").encode(), 1) for t in text])


def remove_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per row of ``docs``."""
    words.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    flags = (
        window_blocks(docs, blocks)
        .groupBy("block")
        .applyInPandas(settle(blocks), "docs long, keys binary")
        .groupBy("docs")
        .applyInPandas(lambda rows: by_document(rows), "doc_id long, found binary, open binary")
    )
    packed = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.pandas_udf(_pack, "binary")("text").alias("packed"))
    located = materialize(
        packed.join(flags, "doc_id").mapInPandas(
            locate(blocks), "doc_id long, digest long, runs binary, anchor long, start long, bytes binary"
        ),
        "windows",
    )
    compared = located.filter("bytes is not null").select("doc_id", "digest", "anchor", "start", "bytes")
    size = compared.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    bins = int(size // BIN_BYTES) + 1
    found = (
        compared.withColumn("_bin", F.expr(f"pmod(xxhash64(anchor), {bins})"))
        .groupBy("_bin")
        .applyInPandas(lambda rows: compare(rows), "doc_id long, digest long, runs binary")
    )
    runs = (
        located.filter("runs is not null").select("doc_id", "digest", "runs")
        .unionByName(found)
        .groupBy("doc_id", "digest")
        .agg(F.collect_list("runs").alias("runs"))
    )

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def finish(packed_texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for packed_text, own in zip(packed_texts, found):
            data = zlib.decompress(packed_text)
            rows.append((len(data), *take_out(data, own)))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # Ids stay out of Python, where a null among them would turn them into doubles.
    joined = packed.join(runs, ["doc_id", "digest"], "left")
    return joined.select("doc_id", finish("packed", "runs").alias("_done")).select("doc_id", "_done.*")
