"""Removal of repeated byte strings by suffix arrays over shards of the places where texts meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import map_batches, read_table, slices, stored

#: Bytes of a repeated string; bytes of the grams that anchor it.
LENGTH, GRAM = 400, 32
#: Window starts that are worked on at once; bytes of fragments in a shard; fragments of an anchor in a shard.
PIECE, SHARD_BYTES, SHARD_FRAGMENTS = 1 << 20, 1 << 19, 500
#: Window starts of a class: neighbours that are compared across shards by what they have in common first.
CLASS = 16
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.full(size, b, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def anchored(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor place, first and last window start of each run of windows with one anchor.

    The anchor of a window of LENGTH bytes is its gram of least hash, the leftmost of equals. It depends on the window's
    bytes alone, so equal windows have equal anchors at the same distance.
    """
    up, down = powers.upto(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    width, windows = LENGTH - GRAM + 1, len(data) - LENGTH + 1
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[width - 1:width - 1 + windows])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], windows) - 1
    return grams[place[first]], place[first], first, last


def fragments(docs: DataFrame, text: str) -> DataFrame:
    """(anchor, fragment, k1, k2, lo, hi, place): runs of windows of every text with their anchor's hash, own hash and place.

    fragment is a hash of the bytes lo to hi + LENGTH and of the anchor's distance from lo.
    """
    powers = Powers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found: list[list[np.ndarray]] = [[] for _ in range(7)]
                for x, k1, k2 in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (x or "").encode("utf-8", "surrogatepass")
                    for begin in range(0, len(raw) - LENGTH + 1, PIECE):
                        piece = raw[begin:begin + PIECE + LENGTH - 1]
                        anchor, place, first, last = anchored(np.frombuffer(piece, np.uint8), powers)
                        own = [xxhash.xxh64_intdigest(piece[a:b + LENGTH], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
                        made = (anchor.view(np.int64), np.array(own, np.uint64).view(np.int64), np.full(len(own), k1), np.full(len(own), k2), (first + begin).astype(np.int32), (last + begin).astype(np.int32), (place + begin).astype(np.int32))
                        for column, values in zip(found, made, strict=True):
                            column.append(values)
                if found[0]:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in found], names=["anchor", "fragment", "k1", "k2", "lo", "hi", "place"])

    return keyed(docs, text).select("text", "k1", "k2").mapInArrow(run, "anchor long, fragment long, k1 long, k2 long, lo int, hi int, place int")


def keyed(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """text, never null, and its 128-bit key (k1, k2)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, whole.alias("text"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"))


def repeated_windows(parts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each fragment, which of its window starts occur elsewhere in the shard, and which stand first among their equals.

    The suffixes of all fragments are put in order by Larsson-Sadakane refinement: a round sorts only groups of more than one
    suffix, by the ranks of what follows the bytes that they share. The last round reaches LENGTH bytes exactly, so suffixes
    that then share a rank are equal windows. A suffix leaves the rounds when its fragment ends before the sorted length.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(parts), np.uint8)
    n = len(text)
    left = np.repeat(begins + sizes, sizes) - np.arange(n)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    # The eight bytes at each position as one number.
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys |= padded[k:k + n] << np.uint64(56 - 8 * k)
    depth, shift = 8, 0
    order = np.flatnonzero(left >= depth)
    slots = np.arange(len(order))
    keys = keys[order]
    rank = np.full(n, -1, np.int64)
    while True:
        # Groups stand in order already, each a run to sort; the stable sort makes use of such runs.
        turn = np.argsort(keys, kind="stable")
        order, keys = order[turn], keys[turn]
        first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        if depth == LENGTH:
            break
        rank[order] = slots[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        shift = min(depth, LENGTH - depth)
        depth += shift
        going = ~(first & np.append(first[1:], True)[: len(first)]) & (left[order] >= depth)
        order, slots = order[going], slots[going]
        keys = rank[order] * (n + 1) + rank[order + shift]
    repeated, heads = np.zeros(n, bool), left >= LENGTH
    repeated[order] = ~(first & np.append(first[1:], True)[: len(first)])
    heads[order] = first
    return [[flags[b:b + s] for b, s in zip(begins, sizes - LENGTH + 1, strict=True)] for flags in (repeated, heads)]


def runs_of(flags: np.ndarray) -> np.ndarray:
    """First and last index of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2) - [0, 1]


def fragment_bytes(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (one of each text's copies counts) with their bytes."""
    lists = stored(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "fragment", "parts", "lo", "hi", "place")).alias("items")))
    texts = keyed(docs, text).join(lists, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        names = ["anchor", "fragment", "parts", "lo", "hi", "place"]
        for batch in batches:
            for part in slices(batch):
                columns: dict[str, list] = {c: [] for c in ("k1", "k2", *names, "data")}
                for k1, k2, x, items in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "items")), strict=True):
                    if (k1, k2) in done:
                        continue
                    done.add((k1, k2))
                    raw = x.encode("utf-8", "surrogatepass")
                    for item in items:
                        columns["k1"].append(k1)
                        columns["k2"].append(k2)
                        for c in names:
                            columns[c].append(item[c])
                        columns["data"].append(raw[item["lo"]:item["hi"] + LENGTH])
                types = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))

    return texts.select("k1", "k2", "text", "items").mapInArrow(run, "k1 long, k2 long, anchor long, fragment long, parts int, lo int, hi int, place int, data binary")


def refined(frame: DataFrame, shards: int) -> DataFrame:
    """(k1, k2, lo, hi, anchor, cell, core, heads): what each shard finds out about its fragments' windows.

    Rows without core are runs of windows that occur more than once in the shard. The others, of anchors that are spread
    over shards, are for the merge: a class of neighbouring windows, a hash of the bytes that all of these have in common,
    and place and hash of those windows that stand first among their equals in the shard.
    """
    cell = F.when(F.col("parts") > 1, F.xxhash64("anchor", F.pmod("fragment", F.col("parts")))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("long"))

    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # Copies of a text read by several tasks bring a fragment several times; it counts once.
        group = group.drop_duplicates(["k1", "k2", "lo"])
        repeated, heads = repeated_windows(group["data"].tolist())
        rows = []
        for r, mark, head in zip(group.itertuples(index=False), repeated, heads, strict=True):
            rows += [(r.k1, r.k2, r.lo + a, r.lo + b, None, None, None, None) for a, b in runs_of(mark).tolist()]
            if r.parts > 1:
                classes: dict[int, list[int]] = {}
                for p in np.flatnonzero(head).tolist():
                    classes.setdefault((r.place - r.lo - p) // CLASS, []).append(p)
                for c, places in classes.items():
                    begin = r.place - r.lo - c * CLASS
                    core = signed(xxhash.xxh64_intdigest(r.data[begin:begin + LENGTH - CLASS + 1], c))
                    firsts = [{"p": r.lo + p, "w": signed(xxhash.xxh64_intdigest(r.data[p:p + LENGTH]))} for p in places]
                    rows.append((r.k1, r.k2, None, None, r.anchor, int(key[0]), core, firsts))
        # Integer columns with gaps are built as such: by way of floats 64-bit numbers would lose their last digits.
        kinds = {"k1": "Int64", "k2": "Int64", "lo": "Int32", "hi": "Int32", "anchor": "Int64", "cell": "Int64", "core": "Int64", "heads": object}
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pd.DataFrame({name: pd.Series(list(c), dtype=kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})

    dealt = frame.withColumn("shard", cell)
    return dealt.groupBy("shard").applyInPandas(
        each, "k1 long, k2 long, lo int, hi int, anchor long, cell long, core long, heads array<struct<p:int,w:long>>"
    )


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def merged(found: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi) of the windows that occur in more than one shard of their anchor.

    A class whose common bytes are in one shard only has no such window. In the others the windows themselves meet.
    """
    classes = found.filter("core is not null").select("k1", "k2", "anchor", "cell", "core", "heads")
    several = (F.min("cell") != F.max("cell")).alias("several")
    open_cores = classes.groupBy("anchor", "core").agg(several).filter("several").drop("several")
    windows = classes.join(open_cores, ["anchor", "core"], "left_semi").select(
        "k1", "k2", "anchor", "cell", "core", F.explode("heads").alias("head")
    ).select("k1", "k2", "anchor", "cell", "core", "head.p", "head.w")
    known = windows.groupBy("anchor", "core", "w").agg(several).filter("several").drop("several")
    return windows.join(known, ["anchor", "core", "w"], "left_semi").select("k1", "k2", F.col("p").alias("lo"), F.col("p").alias("hi"))


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, spans): for each distinct text with repeats the window starts, as closed ranges, that occur elsewhere.

    Windows that are equal share their anchor, so only fragments of one anchor can meet. Fragments that are equal as a
    whole repeat as a whole. Where an anchor has different fragments, these go to shards with a suffix array each. An
    anchor of very many fragments is dealt over several shards, whose windows meet once more by hash. Every occurrence
    counts, so copies of a text repeat each other.
    """
    rows = stored(fragments(docs, text))
    kinds = stored(rows.groupBy("anchor", "fragment").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi", "place")).alias("at")))
    many = kinds.groupBy("anchor").agg(F.count("*").alias("different")).filter("different > 1")
    parts = F.ceil(F.col("different") / F.lit(SHARD_FRAGMENTS)).cast("int").alias("parts")
    meeting = stored(kinds.join(many.select("anchor", parts), "anchor").select("anchor", "fragment", "parts", "at.*"))
    size = meeting.agg(F.sum(F.col("hi") - F.col("lo") + LENGTH).alias("bytes")).first()["bytes"] or 0
    found = stored(refined(fragment_bytes(docs, text, meeting), max(1, -(-size // SHARD_BYTES))))
    equal = kinds.filter("n > 1").select("anchor", "fragment")
    ranges = (
        rows.join(equal, ["anchor", "fragment"], "left_semi").select("k1", "k2", "lo", "hi")
        .union(found.filter("core is null").select("k1", "k2", "lo", "hi"))
        .union(merged(found))
    )
    return ranges.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def covered(spans: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs that windows with these starts cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, kept (the remaining bytes), runs (array of removed byte ranges, ends exclusive).

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the input, in the same text
    included. Null and empty texts, and those below LENGTH bytes, lose nothing. One row per input row, repeated and null
    keys included; other columns are left out.
    """
    found = stored(repeats(docs, text))
    kind = docs.schema[key].dataType.simpleString()
    joined = keyed(docs, text, F.col(key).alias("_key")).join(found, ["k1", "k2"], "left").select("_key", "text", "spans")
    pairs = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept, runs = [], [], [], []
        for x, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = x.encode("utf-8", "surrogatepass")
            cut = covered(spans)
            edges = [0, *(e for c in cut for e in c), len(raw)]
            n.append(len(raw))
            gone.append(sum(b - a for a, b in cut))
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            runs.append([{"begin": a, "end": b} for a, b in cut])
        return pa.record_batch(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, pairs)],
            names=[key, "n_bytes", "n_removed", "kept", "runs"],
        )

    return map_batches(joined, each, f"`{key}` {kind}, n_bytes long, n_removed long, kept binary, runs array<struct<begin:int,end:int>>")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("repeated"),
    )
